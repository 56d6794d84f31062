"""Learned scorers of multivariate series: small networks trained by Spark, a model for each cluster or entity."""
