"""Sharding (operator 6): histogram sort.

Rows are ordered by (hash of text, id, occurrence), so that equal texts are neighbours and yet no key is too heavy to
split. The boundaries between shards are found by counting: each round counts the exact bytes of a few thousand
candidate intervals over all partitions and looks closer only where a boundary lies, until every boundary meets the
tolerance. Then the rows are exchanged once, each straight to its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows

SHARDS = 24
#: A boundary may miss its exact byte target by this share of a shard.
TOLERANCE = 0.002
#: Bits of the key that one round resolves, and bits in each of the key's parts.
ROUND_BITS = 12
PART_BITS = 60
#: Rows and bytes of one exchange partition, about; a larger shard is exchanged in several, MAX_PARTS in all.
PART_ROWS = 250_000
PART_BYTES = 64 << 20
MAX_PARTS = 960
#: A boundary inside a shard only evens out tasks: it may miss its target by this share of a partition.
LOOSE = 0.3


@dataclass(frozen=True)
class Splitters:
    """Boundaries as key prefixes: a row lies behind a boundary if its key is not below it."""

    bounds: list[tuple[int, ...]]
    rows_below: list[int]
    bytes_below: list[int]
    rounds: int


def key_parts(df: DataFrame, id_col: str, text: str) -> tuple[Column, Column, Column]:
    """Three parts of PART_BITS bits each: hash of the text, hash of the id, place in the table."""
    return (
        F.expr(f"shiftrightunsigned(xxhash64(coalesce(`{text}`, '')), {64 - PART_BITS})"),
        F.expr(f"shiftrightunsigned(xxhash64(`{id_col}`), {64 - PART_BITS})"),
        F.monotonically_increasing_id().bitwiseAND((1 << PART_BITS) - 1),
    )


def find_splitters(keys: DataFrame, n: int, tolerance: float = TOLERANCE, fine: int = 1) -> Splitters:
    """Refine n - 1 boundaries over keys(k0, k1, k2, size); every `fine`-th one is a shard's and meets `tolerance`.

    A round brings 2**ROUND_BITS sums for each distinct interval that still holds an unsettled boundary.
    """
    total_rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = 3
    steps = parts * PART_BITS // ROUND_BITS
    # An open boundary: its target, the prefix of its interval, and what lies below that interval.
    open_ = {b: ((), 0, 0) for b in range(1, n)}
    target = {b: total * b // n for b in range(1, n)}
    slacks = {b: max(1, int(total / n * (LOOSE if b % fine else fine * tolerance))) for b in target}
    done: dict[int, tuple[tuple[int, ...], int, int]] = {}
    rounds = 0
    for step in range(steps):
        if not open_ or not total:
            break
        part, inside = divmod(step * ROUND_BITS, PART_BITS)
        digit = lambda s: F.expr(f"shiftright(k{s * ROUND_BITS // PART_BITS}, {PART_BITS - s * ROUND_BITS % PART_BITS - ROUND_BITS}) & {(1 << ROUND_BITS) - 1}")
        prefixes = sorted({p for p, _, _ in open_.values()})
        held = keys
        if step:
            # Digits so far as two longs, compared with the few prefixes that are still open (n - 1 at most).
            within = F.lit(False)
            for p in prefixes:
                same = F.lit(True)
                for q in range(part + 1):
                    own = p[q * PART_BITS // ROUND_BITS : (q + 1) * PART_BITS // ROUND_BITS]
                    if own:
                        value = 0
                        for d in own:
                            value = value << ROUND_BITS | d
                        same = same & (F.expr(f"shiftright(k{q}, {PART_BITS - len(own) * ROUND_BITS})") == value)
                within = within | same
            held = keys.filter(within)
        path = F.array(*[digit(s) for s in range(step)]) if step else F.array().cast("array<bigint>")
        counted = held.groupBy(path.alias("path"), digit(step).alias("digit")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
        rounds += 1
        bins: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        for r in counted:
            bins.setdefault(tuple(r["path"]), []).append((r["digit"], r["rows"], r["bytes"]))
        for v in bins.values():
            v.sort()
        for b, (prefix, rows_below, below) in list(open_.items()):
            last = None
            for d, r, size in bins.get(prefix, ()):
                last = (d, r, size, rows_below, below)
                if below + size > target[b]:
                    break
                rows_below, below = rows_below + r, below + size
            else:
                d, r, size, rows_below, below = last
            d, r, size, rows_below, below = last
            slack = slacks[b]
            before, after = target[b] - below, below + size - target[b]
            if before <= slack or (step == steps - 1 and before <= after):
                done[b] = (prefix + (d,), rows_below, below)
            elif after <= slack or step == steps - 1:
                done[b] = (prefix + (d + 1,), rows_below + r, below + size)
            else:
                open_[b] = (prefix + (d,), rows_below, below)
        for b in done:
            open_.pop(b, None)
    order = [done.get(b, ((1 << ROUND_BITS,), total_rows, total)) for b in range(1, n)]
    return Splitters([x[0] for x in order], [x[1] for x in order] + [total_rows], [x[2] for x in order] + [total], rounds)


def _bound_values(bound: tuple[int, ...]) -> tuple[int, int, int]:
    """A prefix as three part values; a carry out of a part moves into the part before it."""
    per = PART_BITS // ROUND_BITS
    digits = list(bound) + [0] * (3 * per - len(bound))
    whole = 0
    for d in digits:
        whole = (whole << ROUND_BITS) + d
    mask = (1 << PART_BITS) - 1
    return whole >> 2 * PART_BITS, whole >> PART_BITS & mask, whole & mask


def place(bounds: list[tuple[int, ...]]) -> Column:
    """Number of boundaries that are not above (k0, k1, k2): a binary search written as nested conditions."""
    values = [_bound_values(b) for b in bounds]

    def below(v: tuple[int, int, int]) -> Column:
        k0, k1, k2 = F.col("k0"), F.col("k1"), F.col("k2")
        return (k0 < v[0]) | ((k0 == v[0]) & ((k1 < v[1]) | ((k1 == v[1]) & (k2 < v[2]))))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(values[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(values))


def shard(df: DataFrame, shards: int = SHARDS, *, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of df, then size, shard, slot. Shards differ in bytes by `tolerance` of a shard and one row at most.

    size: UTF-8 bytes of the text (null: none) plus 8. slot counts gaplessly from 0 in each shard, in key order. Equal
    texts are neighbours; where they are many, they spread over shards. Null keys and repeated rows are placed like
    any other (repeated rows are told apart by their place in the table). An empty table gives an empty result.
    Columns of df named size, shard or slot are replaced. Null texts count as empty. `df` must give the same rows in the same
    partitions when read again, as a table scan does.
    """
    df = df.drop(*(c for c in ("size", "shard", "slot") if c not in (key, text)))
    work, own, back = rows.masked(df)
    k0, k1, k2 = key_parts(work, own(key), own(text))
    full = work.select("*", (F.coalesce(F.octet_length(own(text)), F.lit(0)).cast("long") + 8).alias("size"), k0.alias("k0"), k1.alias("k1"), k2.alias("k2"))
    keys = rows.checkpoint(full.select("k0", "k1", "k2", "size"))  # a few bytes a row, read once a round
    n_rows, n_bytes = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fine = max(1, min(max(-(-n_rows // (shards * part_rows)), -(-n_bytes // (shards * part_bytes))), MAX_PARTS // shards))
    split = find_splitters(keys, shards * fine, tolerance, fine)
    begin = [0, *split.rows_below[:-1]]
    first = [begin[i // fine * fine] for i in range(shards * fine)]
    offset = F.element_at(F.array(*[F.lit(b - f).cast("long") for b, f in zip(begin, first, strict=True)]), F.col("_part") + 1)
    placed = full.withColumn("_part", place(split.bounds)).repartitionById(shards * fine, F.col("_part")).sortWithinPartitions("k0", "k1", "k2")
    # In a partition the lower 33 bits of this id count the rows from 0.
    here = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = placed.withColumn("slot", offset + here).withColumn("shard", F.expr(f"int(_part div {fine})"))
    return numbered.select(*back, "size", "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(rows.documents(spark, sf_dir))
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
