"""Operators over GPS tracks; all take and return DataFrames."""
