"""Risk analytics over transaction tables and event streams, on Spark DataFrames."""
