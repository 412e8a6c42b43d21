"""Exact group-fair federated clustering with deletion, on Spark DataFrames."""
