"""From program text to DataFrames: grammar, checks, planning."""
