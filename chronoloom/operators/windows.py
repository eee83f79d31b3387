"""Time slots, snapshots, chunks and other ordered cuts of an edge table."""

from __future__ import annotations

import itertools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .edges import assign_position, position_within, running_total


def slot_boundaries_by_event(edges: DataFrame, per_slot: int) -> list[int]:
    """Greedy: from a boundary advance to the first ts at which at least per_slot more events have come; last max + 1.

    Every time gets the boundary that would follow it, by a running count cut into pieces of per_slot events. The chain
    from the first boundary is found by doubling: each round joins the jumps of one length to jumps of twice that
    length. Only the boundaries, and one time for each piece, come to the driver.
    """
    counted = running_total(edges.filter("ts IS NOT NULL").groupBy("ts").agg(F.count("*").alias("n")), ["ts"], "n", "upto")
    first, last, begin = counted.agg(F.min("ts"), F.max("ts"), F.min(F.when(F.col("upto") >= per_slot, F.col("ts")))).first()
    if first is None:
        return []
    piece = F.expr(f"_u div {per_slot}")
    points = counted.select("ts", F.col("upto").alias("_u"), F.lit(1).alias("_o"), F.lit(None).cast("long").alias("_from"))
    asks = counted.select(F.lit(None).cast("long").alias("ts"), (F.col("upto") + per_slot).alias("_u"), F.lit(0).alias("_o"), F.col("ts").alias("_from"))
    behind = Window.partitionBy("_k").orderBy(F.desc("_u"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    found = points.unionByName(asks).withColumn("_k", piece).withColumn("_next", F.min("ts").over(behind)).filter("_o = 0")
    starts = sorted((r["_k"], r["ts"]) for r in points.groupBy(piece.alias("_k")).agg(F.min("ts").alias("ts")).collect())  # a row for each piece
    # An ask lies one piece behind its own time; where that has no later time, the next piece with one answers.
    after = [(k + 1, next((t for q, t in starts[i + 1 : i + 3] if q > k + 1), None)) for i, (k, _) in enumerate(starts)]
    table = edges.sparkSession.createDataFrame(after, "_k long, _after long")
    jump = cut_lineage(found.join(F.broadcast(table), "_k").select(F.col("_from").alias("ts"), F.coalesce("_next", "_after").alias("next")).filter("next IS NOT NULL"))
    chain: set[int] = {first} if begin is None else {first, begin}
    reached = edges.sparkSession.createDataFrame([(begin,)] if begin is not None else [], "ts long")
    while True:
        new = cut_lineage(reached.join(jump, "ts").select(F.col("next").alias("ts")))
        times = [r["ts"] for r in new.collect()]
        if not times:
            return [*sorted(chain), last + 1]
        chain.update(times)
        reached = reached.unionByName(new)
        jump = cut_lineage(jump.join(jump.select(F.col("ts").alias("next"), F.col("next").alias("far")), "next").select("ts", F.col("far").alias("next")))


def slot_boundaries_linspace(lo: int, hi: int, n: int) -> list[float]:
    """n boundaries from lo to hi + 1, hence n - 1 slots."""
    return [lo + i * (hi + 1 - lo) / (n - 1) for i in range(n)]


def slot_assign(edges: DataFrame, boundaries: list[int] | list[float]) -> DataFrame:
    """Slot i is [b_i, b_i+1): the number of boundaries up to ts, less one; null outside. No join."""
    b = F.array(*[F.lit(x) for x in boundaries])
    i = F.size(F.filter(b, lambda x: x <= F.col("ts"))).cast("long") - 1
    return edges.withColumn("slot", F.when((i >= 0) & (i < len(boundaries) - 1), i))


def skip_first_times(edges: DataFrame, skip: int) -> int | None:
    """The first time after the `skip` smallest distinct ones."""
    rows = edges.select("ts").distinct().orderBy("ts").limit(skip + 1).collect()  # skip + 1 rows
    return rows[skip]["ts"] if len(rows) > skip else None


def sliding_snapshots(edges: DataFrame, window: int, lags: int, *, skip: int = 0, keep_over: int = 50) -> DataFrame:
    """Overlapping snapshots: number i holds s + i d <= ts < s + (i + lags + 1) d for i < window - lags.

    d is the time span after the first `skip` times, over `window`. Snapshots of at most keep_over edges are dropped.
    Each edge is copied to the snapshots that cover it: their range follows from its ts, without a join.
    """
    start = skip_first_times(edges, skip)
    end = edges.agg(F.max("ts")).first()[0]
    if start is None or end is None or end == start:
        return edges.withColumn("snap", F.lit(None).cast("int")).limit(0)
    d = (end - start) / window
    at = (F.col("ts") - F.lit(start)) / F.lit(d)
    lo = F.greatest(F.floor(at).cast("int") - lags - 1, F.lit(0))
    hi = F.least(F.floor(at).cast("int") + 1, F.lit(window - lags - 1))
    near = edges.filter(F.col("ts") >= start).withColumn("snap", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    begin, stop = F.lit(float(start)) + F.col("snap") * F.lit(d), F.lit(float(start)) + (F.col("snap") + lags + 1) * F.lit(d)
    inside = near.filter((F.col("ts") >= begin) & (F.col("ts") < stop))
    sizes = inside.groupBy("snap").count().filter(F.col("count") > keep_over).select("snap")
    return inside.join(F.broadcast(sizes), "snap")  # at most `window` rows


def subchunk(edges: DataFrame, max_events: int, by: tuple[str, ...] = ("part", "slot")) -> DataFrame:
    """Within (part, slot), ordered by (cluster, ts, eid): pieces of max_events edges."""
    placed = position_within(edges, by, ["cluster", "ts", "eid"], "_i")
    return placed.withColumn("sub", F.expr(f"_i div {max_events}")).drop("_i")


def subchunk_balanced(edges: DataFrame, max_events: int, by: tuple[str, ...] = ("part", "slot")) -> DataFrame:
    """round(n / max_events) pieces, at least one, cut at the cluster ends nearest to the ideal cuts (ties: the earlier).

    Works on cluster sizes; the edges are touched by one join.
    """
    sizes = edges.groupBy(*by, "cluster").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    ends = sizes.withColumns({"upto": F.sum("c").over(w.orderBy("cluster")), "n": F.sum("c").over(w)})
    ends = ends.withColumn("k", F.greatest(F.round(F.col("n") / max_events).cast("int"), F.lit(1)))
    cuts = ends.filter("k > 1").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    best = cuts.groupBy(*by, "j").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("j") * F.col("n") / F.col("k")).alias("d"), F.col("upto").alias("at"))).alias("m"))
    at = best.groupBy(*by).agg(F.sort_array(F.collect_set("m.at")).alias("ats"))
    piece = F.size(F.filter(F.coalesce("ats", F.array().cast("array<bigint>")), lambda a: a < F.col("upto"))).cast("long")
    pieces = ends.join(at, list(by), "left").select(*by, "cluster", piece.alias("sub"))
    return edges.join(pieces, [*by, "cluster"])


def cluster_to_part(stats: DataFrame, parts: int) -> DataFrame:
    """Clusters by (mean_ts, std_ts, cluster): (i div block) mod parts with block = (max + 1) div (64 parts) + 1."""
    top = stats.agg(F.max("cluster")).first()[0] or 0
    block = (top + 1) // (64 * parts) + 1
    return assign_position(stats, ["mean_ts", "std_ts", "cluster"], "_i").withColumn("part", F.expr(f"(_i div {block}) % {parts}")).drop("_i")


def time_buckets(nodes: DataFrame, n: int = 8) -> DataFrame:
    """nodes(part, node, avg_ts): nearly equal buckets by mean time in each part, the first ones larger by one."""
    placed = position_within(nodes, ["part"], ["avg_ts", "node"], "_i")
    sizes = nodes.groupBy("part").agg(F.count("*").alias("_n"))
    q, r = F.expr(f"_n div {n}"), F.col("_n") % n
    late = r + F.try_divide(F.col("_i") - r * (q + 1), q).cast("long")
    bucket = F.when(F.col("_i") < r * (q + 1), F.expr(f"_i div (_n div {n} + 1)")).otherwise(late)
    return placed.join(F.broadcast(sizes), "part").withColumn("bucket", bucket).drop("_i", "_n")  # a row for each part


def distinct_ts_prefix(edges: DataFrame) -> DataFrame:
    """Each distinct (src, ts) with its number in their order."""
    return assign_position(edges.select("src", "ts").distinct(), ["src", "ts"], "prefix")


def ring_cursor(messages: DataFrame, size: int) -> DataFrame:
    """Slot of each message in a node's ring of `size`: the position in time order, modulo size."""
    return position_within(messages, ["node"], ["ts", "pos"], "slot").withColumn("slot", F.col("slot") % size)


def grouped_steps(ordinal: Column, size: int) -> Column:
    """Consecutive slots or chunks in groups of `size`."""
    return F.floor(ordinal / size)


def chunk_permutation(chunks: DataFrame, epoch: int, seed: int = 0, how: str = "rand") -> DataFrame:
    """A random order of chunks for an epoch, the same on every run."""
    if how != "rand":
        raise ValueError(f"chunk order {how!r} is not implemented")
    return assign_position(chunks.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), "chunk"))), ["_h", "chunk"], "ord").drop("_h")


def geometric_schedule(top: int, n: int) -> list[int]:
    """n whole numbers from top down to 1, in steps of one ratio, rounded up; a single one is the top."""
    if n < 2:
        return [top] * n
    ratio = top ** (1 / (n - 1))
    rising = itertools.accumulate(itertools.repeat(ratio, n - 1), operator.mul, initial=1.0)
    return sorted((min(top, math.ceil(x)) for x in rising), reverse=True)


def parse_shares(text: str) -> list[float]:
    """Comma-separated shares in (0, 1], none above the one before; empty fields do not count."""
    shares = [float(field) for field in text.split(",") if field.strip()]
    outside = [x for x in shares if not 0 < x <= 1]
    if outside or shares != sorted(shares, reverse=True):
        raise ValueError(f"shares must lie in (0, 1] and not rise: {text!r}")
    return shares


def chunk_decay(pattern: str, chunks: int, snaps: int, fulls: int) -> list[int]:
    """How many chunks each of the snaps - fulls older snapshots keeps, nearest first.

    'auto:s' falls geometrically from the share s of all chunks to one chunk; any other pattern lists the shares.
    """
    older = snaps - fulls
    if older < 0:
        raise ValueError("more full snapshots than snapshots")
    whole = lambda share: min(chunks, math.ceil(chunks * share))
    name, _, value = pattern.partition(":")
    if name.strip().lower() == "auto":
        top = whole(max(0.0, float(value)))
        return geometric_schedule(top, older) if top else []
    shares = parse_shares(pattern) if older else []
    if len(shares) < older:
        raise ValueError(f"{older} shares are needed: {pattern!r}")
    return [whole(x) for x in shares[:older]]


def chunk_decay_window(chunks: DataFrame, keep: list[int], fulls: int) -> DataFrame:
    """chunks(snap, chunk): the latest `fulls` snapshots whole, older ones their first keep[age] chunks; none beyond."""
    last = chunks.agg(F.max("snap").alias("_last"))
    age = F.col("_last") - F.col("snap")
    rank = F.row_number().over(Window.partitionBy("snap").orderBy("chunk"))
    quota = F.when(age < fulls, F.lit(1 << 30)).otherwise(F.coalesce(F.get(F.array(*[F.lit(k) for k in keep] or [F.lit(0)]), (age - fulls).cast("int")), F.lit(0)))
    return chunks.crossJoin(F.broadcast(last)).withColumn("_r", rank).filter(F.col("_r") <= quota).drop("_r", "_last")
