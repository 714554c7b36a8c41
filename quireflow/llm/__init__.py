"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``queries`` holds the thin registered forms.
"""
