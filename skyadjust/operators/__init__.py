"""The stages of block adjustment, each a function from DataFrames to DataFrames."""
