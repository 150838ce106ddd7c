"""All registered queries."""

from . import (  # noqa: F401
    queries_log,
    queries_patches,
    queries_sampling,
    queries_scores,
    queries_search,
    queries_volume,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
