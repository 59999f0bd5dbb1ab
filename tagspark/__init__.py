"""Sparse tag-count analytics on Spark: counts per (sample, cell, tag) to verdicts per (set, identity)."""

__version__ = "0.1.0"
