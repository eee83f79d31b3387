"""Aggregates over edges, and quality figures of a preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .edges import endpoints


def degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """In and out events of each node; with nodes, zero for those without."""
    counted = endpoints(edges).groupBy("node").agg(F.count("*").alias("deg"))
    if nodes is None:
        return counted
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def hot_nodes(edges: DataFrame, ratio: float) -> DataFrame:
    """The floor(n * ratio) nodes of highest degree; ties by smaller id. Top-k by a sort with limit, not a window."""
    counted = degree(edges)
    n = int(counted.count() * ratio)
    return counted.orderBy(F.desc("deg"), "node").limit(n)


def weighted_degree(edges: DataFrame) -> DataFrame:
    one = lambda side, name: edges.groupBy(F.col(side).alias("node")).agg(F.sum("w").alias(name))
    both = one("dst", "in_w").join(one("src", "out_w"), "node", "full_outer")
    return both.select("node", F.coalesce("in_w", F.lit(0.0)).alias("in_w"), F.coalesce("out_w", F.lit(0.0)).alias("out_w"))


def snapshot_features(snapshots: DataFrame) -> DataFrame:
    """Per snapshot and node: in- and out-weighted degree, and x = [in, out]."""
    side = lambda c, a, b: snapshots.select("snap", F.col(c).alias("node"), a.alias("i"), b.alias("o"))
    zero = F.lit(0.0)
    both = side("dst", F.col("w"), zero).unionByName(side("src", zero, F.col("w")))
    return both.groupBy("snap", "node").agg(F.sum("i").alias("in_w"), F.sum("o").alias("out_w")).withColumn("x", F.array("in_w", "out_w"))


def snapshot_label(features: DataFrame) -> DataFrame:
    """log(in_w + 1) of the node in its next snapshot; null in its last."""
    nxt = F.lead("in_w").over(Window.partitionBy("node").orderBy("snap"))
    return features.withColumn("label", F.log1p(nxt))


def cumulative_degree(features: DataFrame) -> DataFrame:
    """Total of in + out over all snapshots but the last."""
    last = features.agg(F.max("snap").alias("_last"))
    return features.crossJoin(F.broadcast(last)).filter("snap < _last").groupBy("node").agg(F.sum(F.col("in_w") + F.col("out_w")).alias("deg"))


def size_of(edges: DataFrame) -> DataFrame:
    return edges.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("num_nodes"), F.count("*").alias("num_edges"))


def cluster_time_stats(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster, over both ends of each edge: events, mean and population deviation of ts."""
    ends = edges.select(F.col("src").alias("node"), "ts").unionByName(edges.select(F.col("dst").alias("node"), "ts"))
    return ends.join(clusters, "node").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("ts").alias("mean_ts"), F.stddev_pop("ts").alias("std_ts"))


def first_occurrence(tasks: DataFrame, literal: bool = False) -> DataFrame:
    """Each node with the ts of its first event; literal: of the row with the smallest pos."""
    return tasks.groupBy("node").agg((F.min_by("ts", "pos") if literal else F.min("ts")).alias("ts"))


def argmax_by_ts(rows: DataFrame, key: str = "node") -> DataFrame:
    """Of each key the row with the latest ts, ties by the largest pos."""
    top = F.max(F.struct("ts", "pos")).alias("top")
    return rows.groupBy(key).agg(top).select(key, F.col("top.ts").alias("ts"), F.col("top.pos").alias("pos"))


def running(df: DataFrame, order: list[str], value: str, name: str, *, partition: list[str] | None = None) -> DataFrame:
    """Sum of value over the rows before this one. Without a partition the rows are one sorted range: keep them few."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def indptr(edges: DataFrame, key: str = "dst", buckets: int = 64) -> DataFrame:
    """node, count, indptr: where each node's edges begin in an order by node. Counts are summed range by range.

    Ranges of the id (its upper bits) have sums of their own, so that only `buckets`-odd sums are added in one place.
    """
    counts = edges.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("count"))
    lo, hi = counts.agg(F.min("node"), F.max("node")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // buckets + 1)
    placed = counts.withColumn("_b", F.expr(f"(node - {lo or 0}) div {width}"))
    starts = running(placed.groupBy("_b").agg(F.sum("count").alias("c")), ["_b"], "c", "_start").select("_b", "_start")
    inside = running(placed, ["node"], "count", "_in", partition=["_b"])
    return inside.join(F.broadcast(starts), "_b").select("node", "count", (F.col("_start") + F.col("_in")).alias("indptr"))  # at most buckets + 1 rows


def counts_per(df: DataFrame, key: str, every: DataFrame, name: str = "n") -> DataFrame:
    """Rows for each key of `every`, zero where there are none."""
    return every.select(key).join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").select(key, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def neighbor_part_hist(edges: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """Per target: how many sources lie in each part."""
    owned = edges.join(parts.select(F.col("node").alias("src"), "part"), "src")
    return owned.groupBy(F.col("dst").alias("node")).agg(*[F.count_if(F.col("part") == p).alias(f"part_{p}") for p in range(n)])


def load_balance(book: DataFrame) -> DataFrame:
    """Of book(part, node, is_owned): owned nodes per part (mean, deviation, variation), stored nodes (max, mean)."""
    per = book.groupBy("part").agg(F.count_if("is_owned").alias("owned"), F.count("*").alias("stored"))
    return per.agg(F.avg("owned").alias("owned_mean"), F.stddev_pop("owned").alias("owned_std"), (F.stddev_pop("owned") / F.avg("owned")).alias("owned_cv"), F.max("stored").alias("stored_max"), F.avg("stored").alias("stored_mean"))


def replication(book: DataFrame) -> DataFrame:
    """stored / owned, the halo's share of what is stored, and an alert above two copies a node."""
    total = book.agg(F.count("*").alias("stored"), F.count_if("is_owned").alias("owned"))
    return total.select("stored", "owned", (F.col("stored") / F.col("owned")).alias("replication_factor"), ((F.col("stored") - F.col("owned")) / F.col("stored")).alias("halo_ratio"), (F.col("stored") > 2 * F.col("owned")).alias("alert"))


def temporal_violations(batches: DataFrame) -> DataFrame:
    """batches(batch, ts): batches that begin before the one before has ended. One row a batch in one window."""
    per = batches.groupBy("batch").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    return per.withColumn("violation", F.coalesce(F.col("min_ts") < F.lag("max_ts").over(Window.orderBy("batch")), F.lit(False)))


def leakage(tasks: DataFrame, layers: DataFrame) -> DataFrame:
    """tasks(batch, ts), layers(batch, ts): batches with an edge later than their latest task."""
    t = tasks.groupBy("batch").agg(F.max("ts").alias("task_ts"))
    return t.join(layers.groupBy("batch").agg(F.max("ts").alias("edge_ts")), "batch").withColumn("leak", F.col("edge_ts") > F.col("task_ts"))


def degree_classes(edges: DataFrame, bins: int = 10) -> DataFrame:
    """Nodes in `bins` classes of equal degree width; empty classes are skipped in the numbering."""
    deg = degree(edges)
    span = deg.agg(F.min("deg").alias("_lo"), F.max("deg").alias("_hi"))
    raw = F.least(F.floor((F.col("deg") - F.col("_lo")) * bins / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))), F.lit(bins - 1))
    placed = deg.crossJoin(F.broadcast(span)).withColumn("_c", raw)
    kinds = placed.select("_c").distinct().withColumn("type", F.row_number().over(Window.orderBy("_c")).cast("long") - 1)  # bins rows
    return placed.join(F.broadcast(kinds), "_c").select("node", "deg", "type")
