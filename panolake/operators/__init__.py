"""Operators over DataFrames: joins, matching, tiling, merging, triangulation, control."""
