"""Operators over an `ObjectLog`; every one returns lazy DataFrames."""
