"""Operators: functions from DataFrames to a DataFrame, and the queries that apply them to the model views."""
