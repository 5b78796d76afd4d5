"""Operators over DataFrames of text."""
