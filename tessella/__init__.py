"""Tessella: sketch-based sequence search on Spark DataFrames."""
