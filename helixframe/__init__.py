"""Sequence-expression analytics on Spark DataFrames."""
