"""DataFrame operators: pure functions from DataFrames to DataFrames, keyed by document."""
