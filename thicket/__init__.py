"""Nested-structure forests and their analytics on Spark DataFrames."""
