"""All registered queries and their checks."""

from . import corpus, find, structure  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
