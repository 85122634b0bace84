"""Column expressions: sequences, hashing, sizing formulas."""
