"""Mixing sources to target weights (operator 8, native): multivariate-hypergeometric splitting tree.

Each source is cut into blocks, ranges of a hash of its rows. Targets fix how many draws of blocks a source gives; a
binary tree over the output shards splits these exact quotas, each split a multivariate hypergeometric draw; each
shard then takes its own run of every source's permuted block draws and shuffles locally. Rows meet the plan by a join
on (source, block), so no source, however large, lies in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import rows

WEIGHTS = (5, 2, 1)
CAP = 3
SHARDS = 24
SEED = 17
#: Words in a block, about, until a source has MAX_BLOCKS of them; then its blocks grow.
BLOCK_WORDS = 1 << 16
MAX_BLOCKS = 4096
#: Words in one exchange partition of the mixed rows, about.
PART_WORDS = 4_000_000
#: The per-source plan is made on the driver; more sources than this are refused.
MAX_SOURCES = 200_000
#: Rows of the block table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 50_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    passes: int
    extra: float
    blocks: int


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> list[tuple[str | None, int, float]]:
    """Share the sum of sizes by weight, sources in code-point order with null last, at most cap * size for each.

    The excess of capped sources goes to the others by weight until none is above: a level rises until the sum is met.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    items = [(n, s, weights[i % len(weights)]) for i, (n, s) in enumerate(order)]
    rest, free = sum(s for _, s in order), sum(w for *_, w in items)
    capped: set[int] = set()
    for i in sorted(range(len(items)), key=lambda i: (cap * items[i][1] / items[i][2], i)):
        _, s, w = items[i]
        if rest * w <= cap * s * free:
            break
        capped.add(i)
        rest, free = rest - cap * s, free - w
    level = rest / free if free else 0.0
    return [(n, s, float(cap * s) if i in capped else level * w) for i, (n, s, w) in enumerate(items)]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact quotas (sources) to (sources, shards): a tree of multivariate hypergeometric splits."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = int(quotas.sum())
    room = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[:, lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(q, sum(room[lo:mid]), method="marginals")  # for up to 10**9 blocks in all
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _hash(name: str, seed: int, *parts: str) -> Column:
    return F.xxhash64(F.lit(f"{seed}{name}"), *parts)


def _sized(df: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """Columns of df (masked), its source, size, 48 hash bits of (key, size, text), and the row's place in the table."""
    size = F.size(rows.words(F.col(text))).cast("long")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string"), "_size", F.xxhash64(text)), 16)
    return df.select("*", F.col(source).alias("_source"), size.alias("_size"), F.monotonically_increasing_id().alias("_place")).withColumn("_u", u)


def plan_mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, **options) -> DataFrame:
    """Columns of df, then size, source_size, target, taken and shards: an array with the shard of every copy taken.

    A source's whole passes take each of its rows once more; the remaining part of its target takes whole permuted
    blocks, and in one last block the rows up to a cut of their hash, so that the taken words miss the target by half
    a row. Rows that agree in key, size and text have one hash; where the cut falls among them, they are counted out
    by their place in the table. Rows without words may be taken, too, and add nothing. A null source is a source, the
    last in order; its target follows the same rule. Null texts have no words; null keys and repeated rows are rows
    like others. An empty table gives an empty result. Columns of df with one of the new names are replaced. `df` must
    give the same rows in the same partitions when read again, as a table scan does; the same rows give the same
    result in every run, up to which of several equal rows is taken.
    """
    return _planned(df, weights, **options)[0]


def _planned(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, *, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, int]:
    """plan_mix() with _order, and the words of all sources."""
    df = df.drop(*(c for c in ("size", "source_size", "target", "taken", "shards") if c not in (key, text, source)))
    spark = df.sparkSession
    work, own, back = rows.masked(df)
    sized = _sized(work, own(key), own(text), own(source), seed)
    slim = rows.checkpoint(sized.select("_source", "_size", "_u", "_place"))
    per_source = slim.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan: list[Source] = []
    for name, size, target in targets([(r["_source"], r["size"]) for r in found], weights):
        passes = int(target // size) if size else 0
        passes = min(passes, CAP)
        plan.append(Source(name, size, target, passes, max(0.0, target - passes * size) if passes < CAP else 0.0, max(1, min(MAX_BLOCKS, -(-size // block_words)))))
    fields = T.StructType([T.StructField("_name", T.StringType()), T.StructField("_sid", T.LongType(), False), T.StructField("_source_size", T.LongType(), False), T.StructField("_target", T.DoubleType(), False), T.StructField("_passes", T.IntegerType(), False), T.StructField("_extra", T.DoubleType(), False), T.StructField("_blocks", T.LongType(), False)])
    known = F.broadcast(rows.small_table(spark, [(s.name, i, s.size, s.target, s.passes, s.extra, s.blocks) for i, s in enumerate(plan)], fields))  # at most MAX_SOURCES rows

    def blocked(x: DataFrame, name: Column) -> DataFrame:
        return x.join(known, name.eqNullSafe(F.col("_name"))).withColumn("_block", F.shiftright(F.col("_u") * F.col("_blocks"), 48))

    placed = blocked(slim, F.col("_source"))
    blocks = placed.groupBy("_sid", "_block").agg(F.sum("_size").alias("_words"), F.first("_passes").alias("_passes"), F.first("_extra").alias("_extra"))
    order = Window.partitionBy("_sid").orderBy(_hash("b", seed, "_sid", "_block"), "_block")  # at most MAX_BLOCKS rows each
    upto = F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = blocks.withColumns({"_upto": upto}).withColumn("_before", F.col("_upto") - F.col("_words"))
    full = (F.col("_extra") > 0) & (F.col("_upto") <= F.col("_extra"))
    part = (F.col("_extra") > 0) & ~full & (F.col("_before") < F.col("_extra"))
    ranked = rows.checkpoint(ranked.select("_sid", "_block", "_passes", "_before", "_extra", full.alias("_full"), part.alias("_part")))
    # The last block of each source: hashes are taken up to a cut. The row at the cut is the next hash's; where several
    # rows have that hash, as many of them as come nearest to the target, by place.
    inside = Window.partitionBy("_sid").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)
    final = placed.join(F.broadcast(ranked.filter("_part").select("_sid", "_block", "_before")), ["_sid", "_block"])  # a row for each source
    last = final.groupBy("_sid", "_block", "_u").agg(F.sum("_size").alias("_size"), F.count("*").alias("_n"), F.first("_before").alias("_before"), F.first("_extra").alias("_extra"))
    last = last.withColumn("_to", F.col("_before") + F.sum("_size").over(inside))
    cut = last.groupBy("_sid", "_block").agg(
        F.max(F.when(F.col("_to") <= F.col("_extra"), F.col("_u"))).alias("_cut"),
        F.min(F.when(F.col("_to") > F.col("_extra"), F.struct("_u", F.round(F.try_divide((F.col("_extra") - F.col("_to") + F.col("_size")) * F.col("_n"), F.col("_size"))).cast("long").alias("k")))).alias("_tie"),
    )
    cut = rows.checkpoint(cut.select("_sid", "_block", "_cut", F.col("_tie._u").alias("_tie"), F.col("_tie.k").alias("_k")))  # a row for each source
    table = ranked.join(cut.join(_tie_places(final, cut), "_sid", "left"), ["_sid", "_block"], "left")
    table = table.withColumn("_cut", F.when(F.col("_full"), F.lit(1 << 48)).otherwise(F.coalesce("_cut", F.lit(-1).cast("long"))))
    table = table.withColumn("_last", F.coalesce("_last", F.lit(-1).cast("long")))

    # Draws: a block once for each pass, once more where any of its rows is taken in addition.
    draws = table.withColumn("_draws", F.col("_passes") + F.when((F.col("_cut") >= 0) | (F.col("_last") >= 0), 1).otherwise(0)).filter("_draws > 0").select("_sid", "_block", F.explode(F.sequence(F.lit(1), F.col("_draws"))).alias("_pass"))
    turn = Window.partitionBy("_sid").orderBy(_hash("d", seed, "_sid", "_block", "_pass"), "_block", "_pass")
    draws = rows.checkpoint(draws.withColumn("_rank", F.row_number().over(turn).cast("long") - 1))
    quota = np.zeros(len(plan), np.int64)
    for r in draws.groupBy("_sid").count().collect():  # a row for each source
        quota[r["_sid"]] = r["count"]
    dealt = split_quotas(quota, shards, seed)
    ends = np.cumsum(dealt, axis=1)
    runs = [(i, [int(e) for e in ends[i]]) for i in range(len(plan))]
    runs_df = F.broadcast(rows.small_table(spark, runs, "_sid long, _ends array<long>"))
    shard_of = F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))
    homes = draws.join(runs_df, "_sid").withColumn("_shard", shard_of).groupBy("_sid", "_block").agg(F.sort_array(F.collect_list(F.struct("_pass", "_shard"))).alias("_homes"))  # at most CAP + 1 each
    table = rows.checkpoint(table.join(homes, ["_sid", "_block"], "left").select("_sid", "_block", "_cut", "_tie", "_last", F.coalesce(F.col("_homes")["_shard"], F.array().cast("array<int>")).alias("_homes")))
    if table.count() <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    joined = blocked(sized, F.col("_source")).join(table, ["_sid", "_block"])
    more = (F.col("_u") <= F.col("_cut")) | ((F.col("_u") == F.col("_tie")) & (F.col("_place") <= F.col("_last")))
    copies = F.col("_passes") + F.when(more, 1).otherwise(0)
    full = joined.select(*back, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * copies).alias("taken"), F.slice("_homes", F.lit(1), copies).alias("shards"))
    return full, sum(s.size for s in plan)


def _tie_places(final: DataFrame, cut: DataFrame) -> DataFrame:
    """_sid, _last: the place of the k-th row of the hash at the cut, for each source where k is above 0.

    Counts by input partition find the partition in which it lies; only that partition's rows are ordered.
    """
    part = F.shiftright("_place", 33)
    tied = final.join(F.broadcast(cut.filter("_k > 0").select("_sid", "_tie", "_k")), "_sid").filter("_u = _tie").select("_sid", "_k", "_place", part.alias("_p"))
    upto = F.sum("count").over(Window.partitionBy("_sid").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    home = tied.groupBy("_sid", "_p", "_k").count().withColumn("_upto", upto).filter("_upto >= _k AND _upto - count < _k")
    here = tied.drop("_k").join(F.broadcast(home.select("_sid", "_p", (F.col("_k") - F.col("_upto") + F.col("count")).alias("_k"))), ["_sid", "_p"])  # a row for each source
    order = Window.partitionBy("_sid").orderBy("_place")
    return here.withColumn("_i", F.row_number().over(order)).filter("_i = _k").select("_sid", F.col("_place").alias("_last"))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, *, seed: int = SEED, part_words: int = PART_WORDS, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed rows: columns of df and shard (one of df's is replaced), once for each copy that plan_mix() takes, in
    each shard in an order of their own.

    A shard of more than `part_words` words is dealt in several parts by the rows' hash, and each part sorted there.
    Null keys, texts and sources, ties and repeated rows are treated as in plan_mix(); an empty table gives none.
    """
    work, own, back = rows.masked(df.drop("shard") if "shard" not in (key, text, source) else df)
    planned, words = _planned(work, weights, seed=seed, key=own(key), text=own(text), source=own(source), **options)
    order = F.xxhash64(F.lit(seed), F.col(own(key)).cast("string"), own(text))
    drawn = planned.select(*work.columns, order.alias("_order"), F.posexplode("shards").alias("_copy", "shard"))
    shards = options.get("shards", SHARDS)
    sub = max(1, -(-words // (shards * part_words)))
    drawn = drawn.withColumn("_spot", F.xxhash64(F.lit(seed), "_order", "_copy"))
    part = F.col("_spot")
    if sub > 1:  # a row that is repeated for a whole part or more is dealt by place: fewer than shards * sub such rows
        n = work.count()
        heavy = work.select(order.alias("_order")).groupBy("_order").count().filter(F.col("count") * (shards * sub) > n).select("_order", F.lit(True).alias("_heavy"))
        drawn = drawn.join(F.broadcast(heavy), "_order", "left")
        part = F.when(F.col("_heavy"), F.xxhash64("_spot", F.monotonically_increasing_id())).otherwise(part)
    dealt = drawn.withColumn("_part", (F.col("shard") * sub + F.pmod(part, F.lit(sub))).cast("int"))
    return dealt.repartitionById(shards * sub, F.col("_part")).sortWithinPartitions("_spot").select(*back, "shard")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.documents(spark, sf_dir).select("doc_id", "source", "text")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")
