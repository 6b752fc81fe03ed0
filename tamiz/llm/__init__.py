"""Operators for large training-data pipelines; nothing else in tamiz imports them."""
