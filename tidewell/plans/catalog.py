"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import analytics, bars, choices, comparisons, decisions, judgements, moves, networks, panels, relational, replays, solved, storage, summaries

MODULES = (bars, relational, analytics, replays, solved, choices, summaries, moves, panels, judgements, decisions, storage, comparisons, networks)
FLAGSHIP = bars.breaks_by_year


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
