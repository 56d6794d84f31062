"""Operators: functions from DataFrames (or Columns) to DataFrames (or Columns)."""
