"""Degrees, prefix sums and quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import partition as P
from ..operators import stats as S
from ..operators import windows as W
from ..sources.adapters import Tables, node_parts
from .define import EDGES, NODES, query

DEG = ", dg AS (SELECT node, count(*)::BIGINT AS deg FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node)"
#: Snapshots as plain 200-day windows.
SNAP = EDGES + ", s AS (SELECT ts // 200 AS snap, src, dst, w FROM e)"
FEAT = SNAP + """, f AS (SELECT snap, node, sum(i) AS in_w, sum(o) AS out_w FROM (
  SELECT snap, dst AS node, w AS i, 0.0::DOUBLE AS o FROM s UNION ALL SELECT snap, src, 0.0, w FROM s) GROUP BY 1, 2)"""
BOOK = NODES + """, halo AS (SELECT DISTINCT b.part, src AS node, a.part AS owner FROM e JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.part <> b.part),
k AS (SELECT part, node, TRUE AS is_owned FROM p UNION ALL SELECT part, node, FALSE FROM halo),
book AS (SELECT part, node, is_owned, row_number() OVER (PARTITION BY part ORDER BY is_owned DESC, node) - 1 AS loc FROM k)"""


def snaps(t: Tables):
    return t.purchase_edges().select(F.expr("ts div 200").alias("snap"), "src", "dst", "w")


def graph(t: Tables):
    e = t.purchase_edges()
    return e, node_parts(E.nodes(e))


@query("degree", EDGES + DEG + ", c AS (SELECT DISTINCT c_custkey AS node FROM customer UNION SELECT node FROM dg) SELECT node, coalesce(deg, 0)::BIGINT AS deg FROM c LEFT JOIN dg USING (node)")
def _(t: Tables):
    e = t.purchase_edges()
    every = t.table("customer").select(F.col("c_custkey").alias("node")).unionByName(E.nodes(e)).distinct()
    return S.degree(e, every)


@query("weighted_degree", NODES + " SELECT node, (SELECT coalesce(sum(w), 0) FROM e WHERE dst = node)::DOUBLE AS in_w, (SELECT coalesce(sum(w), 0) FROM e WHERE src = node)::DOUBLE AS out_w FROM n")
def _(t: Tables):
    return S.weighted_degree(t.purchase_edges())


@query("snapshot_features", FEAT + " SELECT snap, node, in_w, out_w FROM f")
def _(t: Tables):
    return S.snapshot_features(snaps(t)).select("snap", "node", "in_w", "out_w")


@query("snapshot_label", FEAT + " SELECT snap, node, round(ln(lead(in_w) OVER (PARTITION BY node ORDER BY snap) + 1), 9) AS label FROM f")
def _(t: Tables):
    return S.snapshot_label(S.snapshot_features(snaps(t))).select("snap", "node", F.round("label", 9).alias("label"))


@query("cumulative_degree", FEAT + " SELECT node, sum(in_w + out_w) AS deg FROM f WHERE snap < (SELECT max(snap) FROM f) GROUP BY node")
def _(t: Tables):
    return S.cumulative_degree(S.snapshot_features(snaps(t)))


SLIDING = EDGES + """, b AS (SELECT s, (m - s) / 20.0::DOUBLE AS d FROM (SELECT min(ts) AS s, max(ts) AS m FROM (SELECT ts FROM e WHERE ts > (SELECT min(ts) FROM e)))),
sl AS (SELECT i AS snap, e.* FROM e, b, (SELECT unnest(range(17)) AS i) x WHERE ts >= s::DOUBLE + i * d AND ts < s::DOUBLE + (i + 4) * d),
sn AS (SELECT * FROM sl WHERE snap IN (SELECT snap FROM sl GROUP BY snap HAVING count(*) > 50))"""


@query("sliding_snapshots", SLIDING + " SELECT snap::INT AS snap, eid, src, dst, w FROM sn")
def _(t: Tables):
    return W.sliding_snapshots(t.purchase_edges(), 20, 3, skip=1).select("snap", "eid", "src", "dst", "w")


@query("life_edges", SLIDING + " SELECT count(*)::BIGINT AS num_life_edges, count(DISTINCT snap)::BIGINT AS num_snapshots FROM sn")
def _(t: Tables):
    return W.sliding_snapshots(t.purchase_edges(), 20, 3, skip=1).agg(F.count("*").alias("num_life_edges"), F.countDistinct("snap").alias("num_snapshots"))


@query("skip_first_times", EDGES + " SELECT min(ts) AS start_ts FROM (SELECT ts, dense_rank() OVER (ORDER BY ts) AS r FROM e) WHERE r > 5")
def _(t: Tables):
    e = t.purchase_edges()
    return e.filter(F.col("ts") >= W.skip_first_times(e, 5)).agg(F.min("ts").alias("start_ts"))


@query("num_nodes", EDGES + " SELECT greatest(max(src), max(dst)) + 1 AS num_nodes, count(*)::BIGINT AS num_edges FROM e")
def _(t: Tables):
    return S.size_of(t.purchase_edges())


STATS = ", ends AS (SELECT src AS node, ts FROM e UNION ALL SELECT dst, ts FROM e), cs AS (SELECT cluster, count(*)::BIGINT AS n, avg(ts) AS mean_ts, stddev_pop(ts) AS std_ts FROM ends JOIN p USING (node) GROUP BY cluster)"


@query("cluster_time_stats", NODES + STATS + " SELECT cluster, n, round(mean_ts, 6) AS mean_ts, round(std_ts, 6) AS std_ts FROM cs")
def _(t: Tables):
    return S.cluster_time_stats(*graph(t)).withColumns({"mean_ts": F.round("mean_ts", 6), "std_ts": F.round("std_ts", 6)})


@query("cluster_to_part", NODES + STATS + " SELECT cluster, ((row_number() OVER (ORDER BY round(mean_ts, 6), round(std_ts, 6), cluster) - 1) // ((SELECT max(cluster) + 1 FROM cs) // 256 + 1)) % 4 AS part FROM cs")
def _(t: Tables):
    rounded = S.cluster_time_stats(*graph(t)).withColumns({"mean_ts": F.round("mean_ts", 6), "std_ts": F.round("std_ts", 6)})
    return W.cluster_to_part(rounded, 4).select("cluster", "part")


@query("distinct_nodes", EDGES + " SELECT src AS node FROM e UNION SELECT dst FROM e")
def _(t: Tables):
    return E.nodes(t.purchase_edges())


@query("dst_pool", EDGES + " SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS idx FROM (SELECT DISTINCT dst FROM e)")
def _(t: Tables):
    return E.assign_position(t.purchase_edges().select("dst").distinct(), ["dst"], "idx")


@query("unique_pairs", EDGES + ", u AS (SELECT src AS node, ts FROM e UNION ALL SELECT dst, ts FROM e) SELECT node, ts, row_number() OVER (ORDER BY node, ts) - 1 AS idx, c::BIGINT AS n FROM (SELECT node, ts, count(*) AS c FROM u GROUP BY 1, 2)")
def _(t: Tables):
    e = t.purchase_edges()
    rows = e.select(F.col("src").alias("node"), "ts").unionByName(e.select(F.col("dst").alias("node"), "ts"))
    return E.assign_position(rows.groupBy("node", "ts").agg(F.count("*").alias("n")), ["node", "ts"], "idx")


@query("first_occurrence", EDGES + " SELECT src AS node, min(ts) AS ts, arg_min(ts, eid) AS literal_ts FROM e GROUP BY src")
def _(t: Tables):
    rows = t.purchase_edges().select(F.col("src").alias("node"), "ts", F.col("eid").alias("pos"))
    return S.first_occurrence(rows).join(S.first_occurrence(rows, literal=True).withColumnRenamed("ts", "literal_ts"), "node")


@query("argmax_by_ts", EDGES + " SELECT node, ts, pos FROM (SELECT src AS node, ts, eid AS pos, row_number() OVER (PARTITION BY src ORDER BY ts DESC, eid DESC) AS r FROM e) WHERE r = 1")
def _(t: Tables):
    return S.argmax_by_ts(t.purchase_edges().select(F.col("src").alias("node"), "ts", F.col("eid").alias("pos")))


@query("csc_indptr", EDGES + ", c AS (SELECT dst AS node, count(*)::BIGINT AS count FROM e GROUP BY dst) SELECT node, count, (sum(count) OVER (ORDER BY node) - count)::BIGINT AS indptr FROM c")
def _(t: Tables):
    return S.indptr(t.purchase_edges())


@query("replica_indptr", BOOK + ", c AS (SELECT node, count(*)::BIGINT AS count FROM (SELECT DISTINCT node, part FROM book) GROUP BY node) SELECT node, count, (sum(count) OVER (ORDER BY node) - count)::BIGINT AS indptr FROM c")
def _(t: Tables):
    return S.indptr(P.partition_book(*graph(t)).select("node", "part").distinct(), "node")


@query("send_sizes", BOOK + ", pp AS (SELECT a.part AS sender, b.part AS receiver FROM (SELECT DISTINCT part FROM p) a, (SELECT DISTINCT part FROM p) b) SELECT sender, receiver, count(node)::BIGINT AS n FROM pp LEFT JOIN halo ON owner = sender AND halo.part = receiver GROUP BY 1, 2")
def _(t: Tables):
    e, p = graph(t)
    every = p.select(F.col("part").alias("sender")).distinct().crossJoin(p.select(F.col("part").alias("receiver")).distinct())  # parts are few
    pair = lambda df: df.withColumn("pair", F.struct("sender", "receiver"))
    return S.counts_per(pair(P.send_lists(e, p)), "pair", pair(every)).select("pair.sender", "pair.receiver", "n")


@query("chunk_clusters", NODES + ", c AS (SELECT a.part, ts // 200 AS slot, a.cluster FROM e JOIN p a ON a.node = dst) SELECT part, slot, list_sort(list(DISTINCT cluster))::VARCHAR AS clusters FROM c GROUP BY 1, 2")
def _(t: Tables):
    e, p = graph(t)
    held = e.join(p.withColumnRenamed("node", "dst"), "dst")
    return held.groupBy("part", F.expr("ts div 200").alias("slot")).agg(F.sort_array(F.collect_set("cluster")).cast("string").alias("clusters"))


@query("neighbor_part_hist", NODES + " SELECT dst AS node, count(*) FILTER (part = 0)::BIGINT AS part_0, count(*) FILTER (part = 1)::BIGINT AS part_1, count(*) FILTER (part = 2)::BIGINT AS part_2, count(*) FILTER (part = 3)::BIGINT AS part_3 FROM e JOIN p ON p.node = src GROUP BY dst")
def _(t: Tables):
    return S.neighbor_part_hist(*graph(t), 4)


@query("snap_bounds", SNAP + ", c AS (SELECT snap, count(*)::BIGINT AS n FROM s GROUP BY snap) SELECT snap, n, (sum(n) OVER (ORDER BY snap) - n)::BIGINT AS begin FROM c")
def _(t: Tables):
    return S.running(snaps(t).groupBy("snap").agg(F.count("*").alias("n")), ["snap"], "n", "begin")


@query("load_balance", BOOK + ", per AS (SELECT part, count(*) FILTER (is_owned) AS owned, count(*) AS stored FROM book GROUP BY part) SELECT avg(owned) AS owned_mean, round(stddev_pop(owned), 9) AS owned_std, round(stddev_pop(owned) / avg(owned), 9) AS owned_cv, max(stored)::BIGINT AS stored_max, avg(stored) AS stored_mean FROM per")
def _(t: Tables):
    return S.load_balance(P.partition_book(*graph(t))).withColumns({"owned_std": F.round("owned_std", 9), "owned_cv": F.round("owned_cv", 9)})


REPL = BOOK + ", r AS (SELECT count(*)::BIGINT AS stored, count(*) FILTER (is_owned)::BIGINT AS owned FROM book) SELECT stored, owned, stored / owned AS replication_factor, (stored - owned) / stored AS halo_ratio, stored > 2 * owned AS alert FROM r"


@query("replication_factor", REPL)
def _(t: Tables):
    return S.replication(P.partition_book(*graph(t)))


@query("halo_ratio", BOOK + " SELECT part, count(*) FILTER (NOT is_owned) / count(*) AS halo_ratio FROM book GROUP BY part")
def _(t: Tables):
    return P.partition_book(*graph(t)).groupBy("part").agg((F.count_if(~F.col("is_owned")) / F.count("*")).alias("halo_ratio"))


@query("temporal_violations", EDGES + ", b AS (SELECT eid // 500 AS batch, min(ts) AS min_ts, max(ts) AS max_ts FROM e GROUP BY 1) SELECT *, coalesce(min_ts < lag(max_ts) OVER (ORDER BY batch), FALSE) AS violation FROM b")
def _(t: Tables):
    return S.temporal_violations(t.purchase_edges().select(F.expr("eid div 500").alias("batch"), "ts"))


@query("temporal_leakage", EDGES + ", b AS (SELECT eid // 500 AS batch, max(ts) AS task_ts FROM e GROUP BY 1), l AS (SELECT eid // 400 AS batch, max(ts) AS edge_ts FROM e GROUP BY 1) SELECT batch, task_ts, edge_ts, edge_ts > task_ts AS leak FROM b JOIN l USING (batch)")
def _(t: Tables):
    e = t.purchase_edges()
    return S.leakage(e.select(F.expr("eid div 500").alias("batch"), "ts"), e.select(F.expr("eid div 400").alias("batch"), "ts"))


@query("route_volume", BOOK + " SELECT owner AS sender, count(*)::BIGINT AS volume, count(*) = 0 AS warning FROM halo GROUP BY owner")
def _(t: Tables):
    sent = P.send_lists(*graph(t)).groupBy("sender").agg(F.count("*").alias("volume"))
    return sent.withColumn("warning", F.col("volume") == 0)


@query("degree_histogram", EDGES + DEG + ", b AS (SELECT node, deg, least(floor((deg - (SELECT min(deg) FROM dg)) * 10 / greatest((SELECT max(deg) - min(deg) FROM dg), 1)), 9) AS c FROM dg) SELECT node, deg, dense_rank() OVER (ORDER BY c) - 1 AS type FROM b")
def _(t: Tables):
    return S.degree_classes(t.purchase_edges())


@query("warp_scan", EDGES + " SELECT eid, sum(w) OVER q AS run_sum, max(w) OVER q AS run_max, min(w) OVER q AS run_min FROM e WINDOW q AS (PARTITION BY src ORDER BY ts, eid ROWS UNBOUNDED PRECEDING)")
def _(t: Tables):
    from pyspark.sql.window import Window

    w = Window.partitionBy("src").orderBy("ts", "eid").rowsBetween(Window.unboundedPreceding, 0)
    return t.purchase_edges().select("eid", *[f("w").over(w).alias(f"run_{n}") for n, f in (("sum", F.sum), ("max", F.max), ("min", F.min))])


@query("hot_nodes", EDGES + DEG + " SELECT node, deg FROM (SELECT node, deg, row_number() OVER (ORDER BY deg DESC, node) AS r, count(*) OVER () AS c FROM dg) WHERE r <= floor(c * 0.1)")
def _(t: Tables):
    return S.hot_nodes(t.purchase_edges(), 0.1)


@query("allreduce_sum_mean_max", SNAP + ", q AS (SELECT src % 4 AS rank, sum(w) AS x, count(*) AS n FROM s GROUP BY 1) SELECT sum(x) AS total, sum(x) / greatest(1e-10, sum(n)) AS mean, max(x) AS top FROM q")
def _(t: Tables):
    per = t.purchase_edges().groupBy((F.col("src") % 4).alias("rank")).agg(F.sum("w").alias("x"), F.count("*").alias("n"))
    return per.agg(F.sum("x").alias("total"), (F.sum("x") / F.greatest(F.lit(1e-10), F.sum("n"))).alias("mean"), F.max("x").alias("top"))
