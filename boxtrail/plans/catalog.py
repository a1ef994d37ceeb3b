"""All queries of the reference's operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from boxtrail.plans import jobs, relational, scalars, streams, timerule  # noqa: F401  they register their queries
from boxtrail.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
