"""Training-data operators: each takes and returns DataFrames; see README.md."""
