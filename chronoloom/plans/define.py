"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The purchase graph and its nodes as common table expressions; a query continues them with a comma or a SELECT.
EDGES = """WITH e AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1)::BIGINT AS eid,
    o_custkey AS src, 1000000000 + l_partkey AS dst, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::BIGINT AS ts,
    l_quantity AS w, (l_returnflag = 'R')::INT AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
NODES = EDGES + """, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
p AS (SELECT node, node % 4 AS part, node % 32 AS cluster FROM n)"""
EVENTS = """WITH e AS MATERIALIZED (
  SELECT event_id AS eid, user_id AS src, 1000000000 + dense_rank() OVER (ORDER BY event_type) AS dst, epoch_us(ts)::BIGINT AS ts, value AS w
  FROM events)"""


def query(name: str, sql: str | None = None):
    """Register fn(tables) under a name, with the SQL that gives the same rows."""

    def keep(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return keep
