"""Registered queries over the given tables; importing this registers them all."""

from cellframe.plans import checks, grids, models, projected, reports, stored, surveys, texts, values

__all__ = ["checks", "grids", "models", "projected", "reports", "stored", "surveys", "texts", "values"]
