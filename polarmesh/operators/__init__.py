"""Operators on meshes, fields, grids, icebergs and restarts: DataFrames in, a DataFrame out."""
