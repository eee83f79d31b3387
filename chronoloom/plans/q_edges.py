"""Scans, projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..sources.adapters import Tables, node_parts
from .define import EDGES, EVENTS, NODES, query


@query("edges_scan", EDGES + " SELECT eid, src, dst, ts, w, label FROM e")
def _(t: Tables):
    return t.purchase_edges()


@query("assign_eid", EDGES + " SELECT eid, src, dst, ts FROM e")
def _(t: Tables):
    return t.purchase_edges().select("eid", "src", "dst", "ts")


@query("event_edges", EVENTS + " SELECT eid, src, dst::BIGINT AS dst, ts, w FROM e")
def _(t: Tables):
    return t.event_edges()


@query("split_by_position", EDGES + """, c AS (SELECT count(*) AS n FROM e)
SELECT eid, CASE WHEN eid < floor(n * 0.7) THEN 'train' WHEN eid < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM e, c""")
def _(t: Tables):
    return E.split_by_position(t.purchase_edges()).select("eid", "split")


@query("split_by_tag", EDGES + " SELECT eid, CASE eid % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM e")
def _(t: Tables):
    return E.split_by_tag(t.purchase_edges().withColumn("ext_roll", F.col("eid") % 3)).select("eid", "split")


@query("split_by_time", EDGES + " SELECT eid, CASE WHEN ts < (SELECT max(ts) * 0.7 FROM e) THEN 'train' ELSE 'eval' END AS split FROM e")
def _(t: Tables):
    return E.split_by_time(t.purchase_edges()).select("eid", "split")


@query("split_batches", EDGES + """, b AS (SELECT DISTINCT eid // 1000 AS batch FROM e),
r AS (SELECT batch, row_number() OVER (ORDER BY batch) - 1 AS i, count(*) OVER () AS n FROM b)
SELECT batch, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r""")
def _(t: Tables):
    return E.split_batches(t.purchase_edges().select(F.expr("eid div 1000").alias("batch")).distinct())


@query("split_snapshots", EDGES + """, s AS (SELECT DISTINCT ts // 100 AS snap FROM e)
SELECT snap, CASE WHEN snap < (SELECT floor((max(snap) + 1) * 0.4) FROM s) THEN 'train' ELSE 'eval' END AS split FROM s""")
def _(t: Tables):
    return E.split_snapshots(t.purchase_edges().select(F.expr("ts div 100").alias("snap")).distinct())


@query("compact_ids", NODES + """, d AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM n)
SELECT eid, a.i::BIGINT AS src_id, b.i::BIGINT AS dst_id FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst""")
def _(t: Tables):
    return E.compact_ids(t.purchase_edges()).select("eid", "src_id", "dst_id")


@query("reverse_edges", EDGES + " SELECT eid, src, dst, ts FROM e UNION ALL SELECT eid, dst, src, ts FROM e")
def _(t: Tables):
    return E.reverse_edges(t.purchase_edges().select("eid", "src", "dst", "ts"))


@query("interleave_reverse", EDGES + " SELECT eid * 2 AS eid, src, dst, ts FROM e UNION ALL SELECT eid * 2 + 1, dst, src, ts FROM e")
def _(t: Tables):
    return E.interleave_reverse(t.purchase_edges().select("eid", "src", "dst", "ts"))


@query("simple_graph", EDGES + " SELECT DISTINCT src, dst FROM e")
def _(t: Tables):
    return E.simple_graph(t.purchase_edges())


LOOPS = ", l AS (SELECT eid, src % 100 AS src, dst % 100 AS dst, ts FROM e)"


def small_world(t: Tables):
    """The purchase graph folded onto 100 nodes, so that self loops and parallel edges occur."""
    return t.purchase_edges().select("eid", (F.col("src") % 100).alias("src"), (F.col("dst") % 100).alias("dst"), "ts")


@query("drop_self_loops", EDGES + LOOPS + " SELECT * FROM l WHERE src <> dst")
def _(t: Tables):
    return E.drop_self_loops(small_world(t))


@query("bidirect", EDGES + " SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def _(t: Tables):
    return E.bidirect(t.purchase_edges())


HOT = """, dg AS (SELECT node, count(*) AS deg FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node),
h AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY deg DESC, node) AS r, count(*) OVER () AS c FROM dg) WHERE r <= floor(c * 0.1))"""


@query("remove_hot", EDGES + HOT + " SELECT eid, src, dst FROM e WHERE src NOT IN (SELECT node FROM h) AND dst NOT IN (SELECT node FROM h)")
def _(t: Tables):
    from ..operators.stats import hot_nodes

    e = t.purchase_edges()
    return E.remove_hot(e, hot_nodes(e, 0.1)).select("eid", "src", "dst")


@query("node_subgraph", NODES + " SELECT eid, src, dst FROM e WHERE src % 4 = 1 AND dst % 4 = 1")
def _(t: Tables):
    e = t.purchase_edges()
    return E.node_subgraph(e, node_parts(E.nodes(e)).filter("part = 1")).select("eid", "src", "dst")


@query("time_range", EDGES + " SELECT eid, src, dst, ts FROM e WHERE ts >= 1500 AND ts < 1900")
def _(t: Tables):
    return E.time_range(t.purchase_edges(), 1500, 1900).select("eid", "src", "dst", "ts")


@query("lower_upper_bound", EDGES + """, r AS (SELECT DISTINCT src AS node, ts AS t FROM e)
SELECT node, t, count(*) FILTER (ts < t)::BIGINT AS lower_bound, count(*) FILTER (ts <= t)::BIGINT AS upper_bound FROM r JOIN e ON src = node GROUP BY node, t""")
def _(t: Tables):
    return E.bounds(t.purchase_edges(), t.roots()).select("node", "t", F.col("lower_bound").cast("long").alias("lower_bound"), F.col("upper_bound").cast("long").alias("upper_bound"))


@query("chunk_filter", EDGES + " SELECT eid, src FROM e WHERE src % 16 IN (1, 3, 5)")
def _(t: Tables):
    e = t.purchase_edges().withColumn("chunk", F.col("src") % 16)
    return E.chunk_filter(e, t.spark.createDataFrame([(1,), (3,), (5,)], "chunk long")).select("eid", "src")


IN_CHUNKS = " FROM e WHERE src % 8 IN (0, 1, 2, 3) AND dst % 8 IN (0, 1, 2, 3) AND ts BETWEEN 1300 AND 1800"


def chunked(t: Tables):
    e = t.purchase_edges()
    return e, E.nodes(e).select("node", (F.col("node") % 8).alias("chunk"))


@query("slice_by_chunk_ts", EDGES + " SELECT src, ts, list_sort(list(eid))::VARCHAR AS eids, list_sort(list(DISTINCT dst))::VARCHAR AS nbrs" + IN_CHUNKS + " GROUP BY src, ts")
def _(t: Tables):
    return E.slice_by_chunk_ts(*chunked(t), [0, 1, 2, 3], 1300, 1800).select("src", "ts", F.col("eids").cast("string").alias("eids"), F.col("nbrs").cast("string").alias("nbrs"))


@query("slice_by_chunk_ts_full", EDGES + ", f AS (SELECT src, ts, count(*) AS c, sum(eid) AS s" + IN_CHUNKS + """ GROUP BY src, ts),
g AS (SELECT s.src, x.ts FROM (SELECT DISTINCT src FROM f) s, (SELECT unnest(range(1300, 1800)) AS ts) x)
SELECT g.src, g.ts, coalesce(c, 0)::BIGINT AS n, coalesce(s, 0)::BIGINT AS eid_sum FROM g LEFT JOIN f USING (src, ts)""")
def _(t: Tables):
    rows = E.slice_by_chunk_ts(*chunked(t), [0, 1, 2, 3], 1300, 1800, full=True)
    return rows.select("src", "ts", F.size("eids").cast("long").alias("n"), F.aggregate("eids", F.lit(0).cast("long"), lambda a, x: a + x).alias("eid_sum"))


@query("feature_slice", "SELECT vec_id, embedding[3]::DOUBLE AS x0, embedding[4]::DOUBLE AS x1, embedding[5]::DOUBLE AS x2, embedding[6]::DOUBLE AS x3 FROM embeddings")
def _(t: Tables):
    x = E.feature_slice(t.table("embeddings").select("vec_id", "embedding"), "embedding", 2, 6)
    return x.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(4)])


@query("range_check", EDGES + """ SELECT count(*) FILTER (src < 0 OR src >= 2000000000)::BIGINT AS bad_src, count(*) FILTER (dst < 0 OR dst >= 2000000000)::BIGINT AS bad_dst,
count(*) FILTER (src IS NULL OR dst IS NULL)::BIGINT AS null_ends, count(*) FILTER (ts IS NULL)::BIGINT AS null_ts, count(*)::BIGINT AS n FROM e""")
def _(t: Tables):
    return E.range_check(t.purchase_edges(), 2_000_000_000)


@query("union_all", EDGES + " SELECT src AS node, ts FROM e UNION ALL SELECT dst, ts FROM e")
def _(t: Tables):
    e = t.purchase_edges()
    return e.select(F.col("src").alias("node"), "ts").unionByName(e.select(F.col("dst").alias("node"), "ts"))


@query("union_distinct", EDGES + " SELECT src AS node, ts FROM e UNION SELECT dst, ts FROM e")
def _(t: Tables):
    e = t.purchase_edges()
    return E.union_distinct(e.select(F.col("src").alias("node"), "ts"), e.select(F.col("dst").alias("node"), "ts"))


@query("except_halo", NODES + " SELECT DISTINCT src AS node FROM e WHERE dst % 4 = 0 EXCEPT SELECT node FROM p WHERE part = 0")
def _(t: Tables):
    e = t.purchase_edges()
    near = e.filter(F.col("dst") % 4 == 0).select(F.col("src").alias("node"))
    return E.except_nodes(near, node_parts(E.nodes(e)).filter("part = 0"))


@query("complement_missing", NODES + " SELECT node FROM n WHERE node NOT IN (SELECT src FROM e WHERE ts < 1200)")
def _(t: Tables):
    e = t.purchase_edges()
    return E.except_nodes(E.nodes(e), e.filter("ts < 1200").select(F.col("src").alias("node")))


@query("intersect", EDGES + " SELECT src AS node FROM e WHERE ts < 1800 INTERSECT SELECT src FROM e WHERE ts > 1600")
def _(t: Tables):
    e = t.purchase_edges()
    return e.filter("ts < 1800").select(F.col("src").alias("node")).intersect(e.filter("ts > 1600").select(F.col("src").alias("node")))
