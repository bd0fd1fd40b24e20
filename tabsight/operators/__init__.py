"""The analysis operators; each takes DataFrames and returns DataFrames."""
