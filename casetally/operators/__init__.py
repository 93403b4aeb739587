"""DataFrame operators: every function here takes and returns DataFrames."""
