"""All queries of the subpackage."""

from matloom.llm import (
    decontaminate,
    language_id,
    packing,
    periodic_runs,
    quality,
    quality_classifier,
    secret_scan,
    simhash,
    suffix_dedup,
    token_alignment,
    token_rollup,
    token_store,
    url_filter,
)
from matloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decontaminate", "language_id", "packing", "periodic_runs", "quality", "quality_classifier", "secret_scan", "simhash", "suffix_dedup", "token_alignment", "token_rollup", "token_store", "url_filter"]
