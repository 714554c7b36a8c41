"""Operators on DataFrames. Those that rank or fill work within a key (page, spread, cell), never over a whole table."""
