"""Regulated floor-area analytics for portfolios of building models, on Spark."""

__version__ = "0.1.0"
