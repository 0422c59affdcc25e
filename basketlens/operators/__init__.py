"""The jobs. Each takes DataFrames and parameters and returns DataFrames."""
