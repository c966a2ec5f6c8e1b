"""Readers that turn files and tables into the library's DataFrames."""
