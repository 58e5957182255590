"""Reading, writing and reshaping the input tables."""
