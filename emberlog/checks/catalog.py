"""All registered queries."""

from emberlog.checks import chains, filters, fits, labelled, profiles, quality, samples, series, sketched, stored, streams, tables, times, vectors, words  # noqa: F401
from emberlog.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
