"""Geospatial event fusion on Spark: conform, score, de-duplicate, detect, serve."""
