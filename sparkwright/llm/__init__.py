"""Operators of a large-scale training-data pipeline. Nothing outside imports this package."""
