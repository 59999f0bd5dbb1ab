"""The registered queries: every operator over the benchmark tables, with the SQL that checks it."""

from . import cells, fits, inputs, panels, quality, reads, sets  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
