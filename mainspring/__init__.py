"""Mainframe records and COBOL source as Spark DataFrames."""
