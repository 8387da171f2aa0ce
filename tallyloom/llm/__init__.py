"""Operators for training-data pipelines. Nothing outside imports them."""
