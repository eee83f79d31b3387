"""Slots, chunks and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import partition as P
from ..operators import windows as W
from ..sources.adapters import Tables, node_parts
from .define import EDGES, NODES, query
from .q_stats import graph

PLACED = NODES + ", c AS (SELECT eid, ts, src, dst, p.part, ts // 365 AS slot, p.cluster FROM e JOIN p ON p.node = dst)"


def placed(t: Tables):
    e, p = graph(t)
    return e.join(p.withColumnRenamed("node", "dst"), "dst").withColumn("slot", F.expr("ts div 365"))


#: Greedy boundaries by recursion over jump targets.
GREEDY = EDGES + """, c AS (SELECT ts, sum(count(*)) OVER (ORDER BY ts) AS cum FROM e GROUP BY ts), RR AS (
  WITH RECURSIVE g AS (SELECT (SELECT min(ts) FROM c) AS b, 0::HUGEINT AS curr UNION ALL
    SELECT (SELECT min(ts) FROM c WHERE cum >= g.curr + 3000), (SELECT min(cum) FROM c WHERE cum >= g.curr + 3000) FROM g WHERE g.curr + 3000 <= (SELECT max(cum) FROM c)) SELECT b FROM g),
bb AS (SELECT DISTINCT b FROM RR UNION SELECT max(ts) + 1 FROM e)"""


@query("slot_by_event", GREEDY + ", x AS (SELECT b, lead(b) OVER (ORDER BY b) AS stop, row_number() OVER (ORDER BY b) - 1 AS slot FROM bb) SELECT slot, b AS ts_start, stop AS ts_end, count(*)::BIGINT AS n FROM x JOIN e ON ts >= b AND ts < stop GROUP BY ALL")
def _(t: Tables):
    e = t.purchase_edges()
    b = W.slot_boundaries_by_event(e, 3000)
    spans = t.spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(b, b[1:]))], "slot long, ts_start long, ts_end long")
    return W.slot_assign(e, b).groupBy("slot").agg(F.count("*").alias("n")).join(F.broadcast(spans), "slot").select("slot", "ts_start", "ts_end", "n")


LIN = EDGES + ", m AS (SELECT min(ts) AS lo, max(ts) + 1 AS hi FROM e), b AS (SELECT i, lo + i * (hi - lo) / 12.0::DOUBLE AS b, lo + (i + 1) * (hi - lo) / 12.0::DOUBLE AS stop FROM m, (SELECT unnest(range(12)) AS i)) SELECT eid, i AS slot FROM e JOIN b ON ts >= b AND ts < stop"


def linspace(t: Tables):
    e = t.purchase_edges()
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    return W.slot_assign(e, W.slot_boundaries_linspace(lo, hi, 13)).select("eid", "slot")


query("slot_by_linspace", LIN)(linspace)


@query("slot_assign", EDGES + " SELECT eid, CASE WHEN ts >= 1100 AND ts < 1500 THEN 0 WHEN ts >= 1500 AND ts < 2900 THEN 1 WHEN ts >= 2900 AND ts < 3000 THEN 2 END::BIGINT AS slot FROM e")
def _(t: Tables):
    return W.slot_assign(t.purchase_edges(), [1100, 1500, 2900, 3000]).select("eid", "slot")


@query("tumbling_slots", EDGES + " SELECT ts // 30 AS slot, count(*)::BIGINT AS n, sum(w) AS w FROM e GROUP BY 1")
def _(t: Tables):
    return t.purchase_edges().groupBy(F.expr("ts div 30").alias("slot")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query("subchunk", PLACED + " SELECT eid, part, slot, (row_number() OVER (PARTITION BY part, slot ORDER BY cluster, ts, eid) - 1) // 200 AS sub FROM c")
def _(t: Tables):
    return W.subchunk(placed(t), 200).select("eid", "part", "slot", "sub")


@query("subchunk_balanced", PLACED + """, z AS (SELECT part, slot, cluster, count(*) AS c FROM c GROUP BY ALL), u AS (SELECT *, sum(c) OVER (PARTITION BY part, slot ORDER BY cluster) AS upto, sum(c) OVER (PARTITION BY part, slot) AS n FROM z),
k AS (SELECT *, greatest(round(n / 200.0::DOUBLE)::INT, 1) AS k FROM u), j AS (SELECT *, unnest(range(1, k)) AS j FROM k WHERE k > 1),
a AS (SELECT DISTINCT part, slot, stop_at FROM (SELECT part, slot, j, upto AS stop_at, row_number() OVER (PARTITION BY part, slot, j ORDER BY abs(upto - j * n / k::DOUBLE), upto) AS r FROM j) WHERE r = 1),
s AS (SELECT u.part, u.slot, u.cluster, count(stop_at)::BIGINT AS sub FROM u LEFT JOIN a ON a.part = u.part AND a.slot = u.slot AND a.stop_at < u.upto GROUP BY ALL)
SELECT eid, part, slot, sub FROM c JOIN s USING (part, slot, cluster)""")
def _(t: Tables):
    return W.subchunk_balanced(placed(t), 200).select("eid", "part", "slot", "sub")


@query("time_buckets", NODES + ", a AS (SELECT node, avg(ts) AS avg_ts FROM (SELECT src AS node, ts FROM e UNION ALL SELECT dst, ts FROM e) GROUP BY node) SELECT node, part, ntile(8) OVER (PARTITION BY part ORDER BY round(avg_ts, 6), node) - 1 AS bucket FROM a JOIN p USING (node)")
def _(t: Tables):
    e, p = graph(t)
    avg = e.select(F.col("src").alias("node"), "ts").unionByName(e.select(F.col("dst").alias("node"), "ts")).groupBy("node").agg(F.round(F.avg("ts"), 6).alias("avg_ts"))
    return W.time_buckets(p.join(avg, "node")).select("node", "part", "bucket")


@query("distinct_ts_prefix", EDGES + " SELECT src, ts, row_number() OVER (ORDER BY src, ts) - 1 AS prefix FROM (SELECT DISTINCT src, ts FROM e)")
def _(t: Tables):
    return W.distinct_ts_prefix(t.purchase_edges())


@query("local_ids", NODES + ", halo AS (SELECT DISTINCT b.part, src AS node FROM e JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.part <> b.part) SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY h, node) - 1 AS loc FROM (SELECT part, node, 0 AS h FROM p UNION ALL SELECT part, node, 1 FROM halo)")
def _(t: Tables):
    return P.partition_book(*graph(t)).select("part", "node", "loc")


@query("ring_cursor", EDGES + " SELECT src AS node, eid AS pos, (row_number() OVER (PARTITION BY src ORDER BY ts, eid) - 1) % 10 AS slot FROM e")
def _(t: Tables):
    return W.ring_cursor(t.purchase_edges().select(F.col("src").alias("node"), "ts", F.col("eid").alias("pos")), 10).select("node", "pos", "slot")


@query("sort_dst_ts", EDGES + " SELECT eid, row_number() OVER (ORDER BY dst, ts, eid) - 1 AS place FROM e")
def _(t: Tables):
    return E.assign_position(t.purchase_edges(), ["dst", "ts", "eid"], "place").select("eid", "place")


@query("sort_graph", EDGES + " SELECT eid, row_number() OVER (ORDER BY src % 8, src, ts, dst % 8, dst, eid) - 1 AS place FROM e")
def _(t: Tables):
    e = t.purchase_edges().withColumns({"sc": F.col("src") % 8, "dc": F.col("dst") % 8})
    return E.assign_position(e, ["sc", "src", "ts", "dc", "dst", "eid"], "place").select("eid", "place")


@query("order_hubs", NODES + ", d AS (SELECT node, part, count(e.eid) AS in_deg FROM p LEFT JOIN e ON dst = node GROUP BY ALL) SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY in_deg DESC, node) - 1 AS ord FROM d")
def _(t: Tables):
    e, p = graph(t)
    deg = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_deg"))
    rows = p.join(deg, "node", "left").select("part", "node", (-F.coalesce("in_deg", F.lit(0))).alias("_d"))
    return E.position_within(rows, ["part"], ["_d", "node"], "ord").select("part", "node", "ord")


@query("rcm_order")
def _(t: Tables):
    e, p = graph(t)
    return P.rcm_order(e, p.select("node", "part", F.pmod(F.expr("cluster div 4"), F.lit(8)).alias("bucket")))


REORDER = NODES + """, d AS (SELECT node, count(*) AS deg, avg(ts) AS avg_ts FROM (SELECT src AS node, ts FROM e UNION ALL SELECT dst, ts FROM e) GROUP BY node),
i AS (SELECT dst AS node, count(*) AS in_deg FROM e GROUP BY dst), a AS (SELECT p.node, part, deg >= 30 AS is_hot, coalesce(in_deg, 0) AS in_deg, round(avg_ts, 6) AS avg_ts FROM p JOIN d USING (node) LEFT JOIN i USING (node)),
x AS (SELECT node, part, 0 AS c, 0 AS bucket, -in_deg AS k FROM a WHERE is_hot UNION ALL SELECT node, part, 1, ntile(8) OVER (PARTITION BY part ORDER BY avg_ts, node) - 1, 0 FROM a WHERE NOT is_hot),
pm AS (SELECT node, row_number() OVER (ORDER BY part, c, bucket, k, node) - 1 AS new_id FROM x)"""


def permutation(t: Tables):
    e, p = graph(t)
    both = e.select(F.col("src").alias("node"), "ts").unionByName(e.select(F.col("dst").alias("node"), "ts"))
    d = both.groupBy("node").agg(F.count("*").alias("deg"), F.round(F.avg("ts"), 6).alias("avg_ts"))
    i = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_deg"))
    a = p.join(d, "node").join(i, "node", "left").select("node", "part", (F.col("deg") >= 30).alias("is_hot"), F.coalesce("in_deg", F.lit(0)).alias("in_deg"), "avg_ts")
    return e, P.reorder_perm(a)


@query("reorder_perm", REORDER + " SELECT new_id, node FROM pm")
def _(t: Tables):
    return permutation(t)[1]


@query("apply_perm", REORDER + " SELECT eid, a.new_id AS src, b.new_id AS dst FROM e JOIN pm a ON a.node = src JOIN pm b ON b.node = dst")
def _(t: Tables):
    return P.apply_perm(*permutation(t)).select("eid", "src", "dst")


@query("sort_by_target", NODES + ", h AS (SELECT DISTINCT a.part AS sender, b.part AS receiver, src AS node FROM e JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.part <> b.part) SELECT *, row_number() OVER (PARTITION BY sender, receiver ORDER BY node) - 1 AS ord FROM h")
def _(t: Tables):
    return P.send_lists(*graph(t))


@query("limit_fanout", EDGES + " SELECT src, dst, ts, eid FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts DESC, eid DESC) AS r FROM e) WHERE r <= 5")
def _(t: Tables):
    from pyspark.sql.window import Window

    w = Window.partitionBy("src").orderBy(F.desc("ts"), F.desc("eid"))
    return t.purchase_edges().withColumn("r", F.row_number().over(w)).filter("r <= 5").select("src", "dst", "ts", "eid")


SLOTS = EDGES + ", s AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS ord FROM (SELECT DISTINCT ts // 10 AS slot FROM e))"


def slots(t: Tables):
    return E.assign_position(t.purchase_edges().select(F.expr("ts div 10").alias("slot")).distinct(), ["slot"], "ord")


@query("seq_batches", SLOTS + " SELECT slot, ord // 4 AS step FROM s")
def _(t: Tables):
    return slots(t).select("slot", W.grouped_steps(F.col("ord"), 4).alias("step"))


@query("mega_batches", SLOTS + " SELECT slot, ord // 100 AS mega FROM s")
def _(t: Tables):
    return slots(t).select("slot", W.grouped_steps(F.col("ord"), 100).alias("mega"))


@query("chunk_permutation", SLOTS + " SELECT slot AS chunk, row_number() OVER (ORDER BY md5('0|3|' || slot), slot) - 1 AS ord FROM s")
def _(t: Tables):
    return W.chunk_permutation(slots(t).select(F.col("slot").alias("chunk")), epoch=3)


@query("parse_chunk_decay", "SELECT * FROM (VALUES ('auto:0.1', 0, 2), ('auto:0.1', 1, 2), ('auto:0.1', 2, 2), ('auto:0.1', 3, 1), ('0.5,0.25', 0, 8), ('0.5,0.25', 1, 4)) v(pattern, age, chunks)")
def _(t: Tables):
    rows = [("auto:0.1", i, k) for i, k in enumerate(W.chunk_decay("auto:0.1", 16, 6, 2))] + [("0.5,0.25", i, k) for i, k in enumerate(W.chunk_decay("0.5,0.25", 16, 4, 2))]
    return t.spark.createDataFrame(rows, "pattern string, age int, chunks int")


@query("chunk_decay_window", EDGES + ", c AS (SELECT DISTINCT ts // 200 AS snap, src % 16 AS chunk FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY chunk) AS r, (SELECT max(snap) FROM c) - snap AS age FROM c) SELECT snap, chunk FROM r WHERE age < 2 OR r <= CASE age WHEN 2 THEN 8 WHEN 3 THEN 4 ELSE 0 END")
def _(t: Tables):
    chunks = t.purchase_edges().select(F.expr("ts div 200").alias("snap"), (F.col("src") % 16).alias("chunk")).distinct()
    return W.chunk_decay_window(chunks, W.chunk_decay("0.5,0.25", 16, 4, 2), 2).select("snap", "chunk")
