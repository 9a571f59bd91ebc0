"""spanloom: interval-overlap, sequence and corpus analytics on Spark DataFrames."""
