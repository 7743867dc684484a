"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import calibration, features, labels, machines, neighbours, operations, places, recordings, scenes, snapshots, sweeps  # noqa: F401  they register
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
