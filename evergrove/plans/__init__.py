"""The path language: text to syntax tree to DataFrames."""
