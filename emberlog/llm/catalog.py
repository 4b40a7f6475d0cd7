"""All queries of the subpackage."""

from emberlog.llm import (  # noqa: F401
    byte_bpe, chat_format, curve_packing, decontamination, filter_audit, hard_negatives, license_scan, near_duplicates,
    page_templates, quality_rules, repeated_spans, ring_sharding, token_counts,
)
from emberlog.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
