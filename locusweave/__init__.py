"""Segment reproducibility analytics on Spark."""
