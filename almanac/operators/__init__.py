"""Operators: plain functions from DataFrames of (series_id, date, value) to DataFrames."""
