"""Projections, filters and set operations over edges(eid, src, dst, ts[, w])."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, pack


def assign_position(df: DataFrame, order: Sequence[str], name: str = "eid", keep: Sequence[str | Column] | None = None, packed: bool = False) -> DataFrame:
    """Position of each row, from 0, in a declared unique order; nulls come first. keep: columns to carry, all if not given.
    packed: written as compressed Parquet, for large tables of plain types.

    Rows are dealt by ranges of all order columns, sorted there and written once; a range's rows start where the counts
    of the ranges before end. No task holds more than a range, whatever the order columns' values.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of this id are the partition, the lower 33 count its rows from 0.
    placed = (pack if packed else cut_lineage)(ranged.select(*(keep if keep is not None else df.columns), F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    counts = {r["_p"]: r["n"] for r in placed.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    starts, begin = [], 0
    for p in sorted(counts):
        starts.append((p, begin))
        begin += counts[p]
    table = df.sparkSession.createDataFrame(starts, "_p long, _begin long")
    here = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_begin") + here).drop("_p", "_at", "_begin")


def position_within(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Position of each row, from 0, in its group, in an order that is unique there. A group of any size spreads over tasks.

    Positions of the whole table, less the first one of the group.
    """
    carried = [*dict.fromkeys([*(df.columns if keep is None else keep), *by])]
    placed = assign_position(df, [*by, *order], "_pos", carried)
    first = placed.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min("_pos").alias("_first"))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)])
    return placed.join(first, same).withColumn(name, F.col("_pos") - F.col("_first")).drop("_pos", "_first", *[f"_g{i}" for i in range(len(by))])


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of a whole-number column over the rows up to each one, in a unique order; ranges are summed alone and start where others end."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.sum(value).alias("n")).collect()}  # a row for each range
    starts, begin = [], 0
    for p in sorted(sums):
        starts.append((p, begin))
        begin += sums[p] or 0
    table = df.sparkSession.createDataFrame(starts, "_p int, _begin long")
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_s", inside).join(F.broadcast(table), "_p").withColumn(name, F.col("_begin") + F.col("_s")).drop("_p", "_s", "_begin")


def running_within(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """running_total() that starts anew in each group; a group of any size spreads over tasks. No null groups."""
    placed = running_total(df, [*by, *order], value, "_total")
    first = placed.groupBy(*by).agg(F.min(F.col("_total") - F.col(value)).alias("_first"))
    return placed.join(first, list(by)).withColumn(name, F.col("_total") - F.col("_first")).drop("_total", "_first")


def split_by_position(edges: DataFrame, train: float = 0.7, val: float = 0.85) -> DataFrame:
    total = edges.agg(F.count("*").alias("_n"))
    where = F.when(F.col("eid") < F.floor(F.col("_n") * train), "train").when(F.col("eid") < F.floor(F.col("_n") * val), "val").otherwise("test")
    return edges.crossJoin(F.broadcast(total)).withColumn("split", where).drop("_n")  # one row


def split_by_tag(edges: DataFrame, tag: str = "ext_roll") -> DataFrame:
    return edges.withColumn("split", F.when(F.col(tag) == 0, "train").when(F.col(tag) == 1, "val").when(F.col(tag) == 2, "test"))


def split_by_time(edges: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Training edges lie before ratio * max(ts)."""
    last = edges.agg((F.max("ts") * ratio).alias("_cut"))
    return edges.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col("ts") < F.col("_cut"), "train").otherwise("eval")).drop("_cut")  # one row


def split_batches(batches: DataFrame, order: str = "batch", train: float = 0.7, val: float = 0.15) -> DataFrame:
    """70 / 15 / rest by ordinal of the batch; batches has one row a batch and is small."""
    total = batches.agg(F.count("*").alias("_n"))
    i = F.row_number().over(Window.orderBy(order)) - 1
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    return batches.crossJoin(F.broadcast(total)).withColumn("_i", i).withColumn("split", F.when(F.col("_i") < a, "train").when(F.col("_i") < a + b, "val").otherwise("test")).drop("_i", "_n")


def split_snapshots(snapshots: DataFrame, ratio: float = 0.4) -> DataFrame:
    last = snapshots.agg(F.floor((F.max("snap") + 1) * ratio).alias("_cut"))
    return snapshots.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col("snap") < F.col("_cut"), "train").otherwise("eval")).drop("_cut")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))


def nodes(edges: DataFrame) -> DataFrame:
    return endpoints(edges).distinct()


def compact_ids(edges: DataFrame) -> DataFrame:
    """src and dst renumbered densely in the order of their ids."""
    dense = assign_position(nodes(edges), ["node"], "new_id")
    pick = lambda side: dense.select(F.col("node").alias(side), F.col("new_id").alias(f"{side}_id"))
    return edges.join(pick("src"), "src").join(pick("dst"), "dst")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """The edges and their reverses, which keep eid."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def interleave_reverse(edges: DataFrame) -> DataFrame:
    """Forward edges get eid 2 i, reverses 2 i + 1."""
    both = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), F.lit(0).alias("way")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), F.lit(1).alias("way"))))
    rest = [c for c in edges.columns if c not in ("src", "dst", "eid")]
    return edges.withColumn("_e", both).select((F.col("eid") * 2 + F.col("_e.way")).alias("eid"), F.col("_e.s").alias("src"), F.col("_e.d").alias("dst"), *rest)


def original_edge(eid: Column) -> tuple[Column, Column]:
    """Of an interleaved eid: the original one, and the direction (0 forward)."""
    return F.shiftright(eid, 1), eid.bitwiseAND(1)


def simple_graph(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def bidirect(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def remove_hot(edges: DataFrame, hot: DataFrame) -> DataFrame:
    """Edges with neither end in hot(node)."""
    h = hot.select("node").distinct()
    return edges.join(h.withColumnRenamed("node", "src"), "src", "left_anti").join(h.withColumnRenamed("node", "dst"), "dst", "left_anti")


def node_subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep(node)."""
    k = keep.select("node").distinct()
    return edges.join(k.withColumnRenamed("node", "src"), "src", "left_semi").join(k.withColumnRenamed("node", "dst"), "dst", "left_semi")


def time_range(edges: DataFrame, begin: int, end: int) -> DataFrame:
    return edges.filter((F.col("ts") >= begin) & (F.col("ts") < end))


def bounds(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """For probes(node, t): edges of the source before t (lower bound) and up to t (upper bound)."""
    from .sampling import History

    history = History(edges, "out")
    lower, upper = history.cuts(probes), history.cuts(probes, equal_root_time=True)
    return lower.withColumnRenamed("cut", "lower_bound").join(upper.withColumnRenamed("cut", "upper_bound"), ["node", "t"])


def chunk_filter(edges: DataFrame, chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    return edges.join(chunks.select(chunk).distinct(), chunk, "left_semi")


def slice_by_chunk_ts(edges: DataFrame, node_chunks: DataFrame, chunks: Sequence[int], begin: int, end: int, full: bool = False) -> DataFrame:
    """Edges with both ends in the chunks and begin <= ts <= end, by (src, ts): eids and their neighbours.

    full enumerates every integer ts in [begin, end) for each source found, with empty lists where it has no edge.
    """
    inside = node_chunks.filter(F.col("chunk").isin(list(chunks))).select("node")
    found = node_subgraph(edges.filter(F.col("ts").between(begin, end)), inside)
    rows = found.groupBy("src", "ts").agg(F.sort_array(F.collect_list("eid")).alias("eids"), F.sort_array(F.collect_set("dst")).alias("nbrs"))
    if not full:
        return rows
    grid = found.select("src").distinct().withColumn("ts", F.explode(F.sequence(F.lit(begin).cast("long"), F.lit(end - 1).cast("long"))))
    none = F.array().cast("array<bigint>")
    return grid.join(rows, ["src", "ts"], "left").select("src", "ts", F.coalesce("eids", none).alias("eids"), F.coalesce("nbrs", none).alias("nbrs"))


def feature_slice(df: DataFrame, column: str, begin: int, end: int) -> DataFrame:
    return df.withColumn(column, F.slice(column, begin + 1, end - begin))


def range_check(edges: DataFrame, limit: int) -> DataFrame:
    """One row: counts of ids outside [0, limit), null ends and null times; all 0 for a sound table."""
    bad = lambda c: F.count_if((F.col(c) < 0) | (F.col(c) >= limit))
    return edges.agg(bad("src").alias("bad_src"), bad("dst").alias("bad_dst"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("null_ends"), F.count_if(F.col("ts").isNull()).alias("null_ts"), F.count("*").alias("n"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def except_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct nodes of a that are not in b."""
    return a.select("node").distinct().join(b.select("node").distinct(), "node", "left_anti")
