"""All registered queries."""

from pluvia.plans import (  # noqa: F401
    queries_files,
    queries_radar,
    queries_samples,
    queries_scores,
    queries_sites,
    queries_streams,
    queries_tables,
)
from pluvia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
