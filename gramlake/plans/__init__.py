"""The registered queries of the engine and their SQL."""

from gramlake.plans import files, unary, pairwise, rounds, stats, streams, wide  # noqa: F401, I001
from gramlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
