"""Operators over DataFrames of records and source."""
