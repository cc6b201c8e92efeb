"""Operators: functions from DataFrames to DataFrames, all lazy plans of built-in expressions."""
