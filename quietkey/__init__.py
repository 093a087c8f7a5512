"""Secret-exposure scanning and candidate analysis on Spark DataFrames."""
