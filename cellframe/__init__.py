"""Raster and survey analytics on Spark tables."""
