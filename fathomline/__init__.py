"""Spark-native observability analytics: series, detection, event clustering, service graphs and root-cause ranking."""
