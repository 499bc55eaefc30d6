"""All catalogue queries, imported for their registration side effect."""

from __future__ import annotations

from . import (  # noqa: F401
    q_features, q_metrics, q_models, q_nulls, q_profile, q_relational, q_sources, q_text, recipes, recipes_tabular,
)
from .common import REGISTRY, tbl  # noqa: F401

ENTRY_QUERY = "q_wide_row"


def queries():
    return {name: fn for name, (fn, _sql) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_fn, sql) in REGISTRY.items() if sql is not None}
