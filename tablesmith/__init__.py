"""Relational data synthesis, profiling and data quality on Spark DataFrames."""
