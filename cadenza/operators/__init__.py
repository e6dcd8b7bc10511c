"""Operators over DataFrames keyed by series_id."""
