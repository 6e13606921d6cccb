"""Tidemark: customer-health analytics expressed as Spark DataFrames."""
