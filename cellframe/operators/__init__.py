"""Operators on tables of cells, surveys, scenes and samples."""
