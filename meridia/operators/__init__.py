"""Operators as functions from DataFrames to DataFrames."""
