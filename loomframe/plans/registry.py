"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.plans import (
    clip_plans,
    document_plans,
    graph_plans,
    pixel_plans,
    stream_plans,
    table_plans,
    track_plans,
)

_GROUPS = (clip_plans, table_plans, pixel_plans, track_plans, graph_plans, document_plans, stream_plans)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _group in _GROUPS:
    QUERIES.update(_group.QUERIES)
    ORACLES.update(_group.ORACLES)
