"""Relational and list operators on DataFrames and array columns."""
