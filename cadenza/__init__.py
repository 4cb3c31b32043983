"""Sequence, signal and corpus analytics on Spark DataFrames."""
