"""Fathomline: fused text retrieval and embedding maintenance on Spark DataFrames."""
