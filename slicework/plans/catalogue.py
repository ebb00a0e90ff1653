"""All queries of the library on the standard tables, and the SQL that each must equal."""

from __future__ import annotations

from slicework.plans import arrays, evaluation, filesets, names, pairing, reports, runs, storage  # noqa: F401  registers their queries
from slicework.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
