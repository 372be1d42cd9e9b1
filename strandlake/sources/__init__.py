"""Record files as DataFrames, and back."""
