"""All registered queries, gathered by importing their modules."""

from __future__ import annotations

from . import (  # noqa: F401
    catalog_queries,
    curation_queries,
    dataset_queries,
    execution_queries,
    linking_queries,
    profile_queries,
    reward_queries,
    round_queries,
    scoring_queries,
    source_queries,
)
from .dataset_queries import run_flagship as flagship
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
