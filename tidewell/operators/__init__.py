"""Relational operators over listings: pure functions of DataFrames and Columns."""
