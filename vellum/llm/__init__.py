"""Training-data operators: ten jobs from DataFrames to DataFrames."""
