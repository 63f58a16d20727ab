"""Operators for preparing language-model training data, each a function from DataFrames to a DataFrame."""
