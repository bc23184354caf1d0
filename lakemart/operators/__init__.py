"""Table operators: DataFrames in, DataFrame out, nothing is written."""
