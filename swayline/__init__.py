"""Contest-outcome sensitivity analysis on Spark DataFrames."""
