"""Catalogue provenance, matching and refresh on Spark DataFrames."""
