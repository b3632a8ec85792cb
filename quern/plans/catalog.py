"""All registered queries of the engine, with their DuckDB twins."""

from __future__ import annotations

from quern.plans import ingest, more, relational, sessions, stored, streams, texts, usage, wider  # noqa: F401  they register their queries
from quern.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "leaderboard_week_day"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
