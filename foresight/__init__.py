"""Foresight: point-in-time retention and revenue analytics on Spark DataFrames."""
