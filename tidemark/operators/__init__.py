"""Operators: functions from DataFrames to a DataFrame, with no hidden clock."""
