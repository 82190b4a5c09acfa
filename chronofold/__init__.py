"""Chronofold: time-safe product-discovery analytics on Spark."""
