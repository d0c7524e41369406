"""Relational, text and timeline operators on DataFrames."""
