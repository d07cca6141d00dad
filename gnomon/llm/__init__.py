"""Operators for large-scale training-data pipelines (one module per operator)."""
