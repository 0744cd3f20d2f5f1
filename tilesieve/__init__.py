"""Spatial duplicate analytics on Spark."""
