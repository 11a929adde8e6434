"""Evaluation analytics for scored classification workloads, on Spark DataFrames."""
