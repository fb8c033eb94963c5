"""Operators over DataFrames: each takes and returns DataFrames and says what it does with nulls and ties."""
