"""Quality classifier (operator 9): factorisation machine.

Inputs of a score are hashed words, binned structure statistics of the text, and its length as metadata. Pairwise
interactions have low rank and cost linear time: sum over factors of ((sum v x)^2 - sum v^2 x^2) / 2. The model is fit
on the driver from features of a bounded sample of labelled rows; scoring is one pass over the table without shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows
from .tokens import text_bytes

#: Labelled rows from which the model learns, at most.
SAMPLE = 6000
BUCKETS = 1 << 15
BINS = 12
RANK = 4
EPOCHS = 8
SEED = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes: 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 sentence end, 6 comma and such, 7 exclamation, 8 high, 9 space
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[list(b"#*$%&|<>")] = 4
_CLASS[list(b".?")], _CLASS[list(b",;:")], _CLASS[33] = 5, 6, 7
_CLASS[128:], _CLASS[_SPACE] = 8, 9
_WEIGHTS = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STATS = 18
WIDTH = BUCKETS + _STATS * BINS


def _pieces(data: np.ndarray, cut: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not `cut`, ended by document ends, too: (hash, document, length)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~cut
    start = inside.copy()
    start[1:] &= cut[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.cumsum(start) - 1
    place = (np.arange(len(data)) - at[np.maximum(own, 0)]) & 4095
    part = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place], np.uint64(0))
    h = np.add.reduceat(part, at)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15), doc[at], np.add.reduceat(inside.astype(np.int64), at)


def features(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document, feature, value), sorted by document. chars: metadata, NaN where unknown."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    h, wdoc, wlen = _pieces(data, _SPACE[data], doc)
    n_words = np.bincount(wdoc, minlength=n)
    key, count = np.unique(wdoc * BUCKETS + (h >> np.uint64(49)).astype(np.int64), return_counts=True)
    kdoc = key // BUCKETS
    distinct = np.bincount(kdoc, minlength=n)
    value = np.sqrt(count) / np.sqrt(np.maximum(1, n_words))[kdoc]
    kind = np.bincount(doc * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10).astype(float)
    total = np.maximum(1.0, np.diff(offsets))
    lh, ldoc, llen = _pieces(data, data == 10, doc)
    n_lines = np.bincount(ldoc, minlength=n)
    if len(lh):
        line_doc = ldoc[np.unique(np.stack((ldoc.astype(np.uint64), lh)), axis=1, return_index=True)[1]]
        same = n_lines - np.bincount(line_doc, minlength=n)
    else:
        same = np.zeros(n)
    letters = np.maximum(1.0, kind[:, 1] + kind[:, 2])
    words = np.maximum(1, n_words)
    # The last byte of each word, by class.
    if len(wdoc):
        inside = ~_SPACE[data]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
        last = np.bincount(wdoc * 10 + _CLASS[data[np.flatnonzero(stop)]], minlength=n * 10).reshape(n, 10)
    else:
        last = np.zeros((n, 10))
    share = lambda a, b: np.clip(np.sqrt(a / b), 0, 1)
    log = lambda a, top: np.clip(np.log1p(a) / np.log(top), 0, 1)
    known = ~np.isnan(chars)
    stats = np.stack(
        [
            log(n_words, 3e4), log(n_lines, 3e3), share(distinct, words), share(kind[:, 1], letters), share(kind[:, 3], total), share(kind[:, 4], total),
            share(kind[:, 5], words), share(kind[:, 6], words), share(kind[:, 7], words), share(kind[:, 8], total), share(last[:, 4], words), share(last[:, 5], words),
            share(last[:, 7], words), share(same, np.maximum(1, n_lines)), log(np.bincount(wdoc, wlen, n) / words, 60), log(n_words / np.maximum(1, n_lines), 400),
            share(np.bincount(wdoc, wlen == 1, n), words), np.where(known, log(np.nan_to_num(chars), 3e5), 0),
        ],
        axis=1,
    )
    bins = np.minimum(BINS - 1, (stats * BINS).astype(np.int64)) + np.arange(_STATS) * BINS + BUCKETS
    alldoc = np.concatenate((kdoc, np.repeat(np.arange(n), _STATS)))
    allkey = np.concatenate((key % BUCKETS, bins.ravel()))
    allval = np.concatenate((value, np.full(n * _STATS, 0.5)))
    order = np.argsort(alldoc, kind="stable")
    return alldoc[order], allkey[order], allval[order]


def raw_scores(model: tuple[float, np.ndarray], doc: np.ndarray, key: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
    """The machine's output before the sigmoid; model[1] has the linear weight and the factors of each feature."""
    bias, table = model
    out = np.full(n, bias)
    if len(doc):
        x = table[key] * val[:, None]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        sums, squares = np.add.reduceat(x, first), np.add.reduceat(x[:, 1:] ** 2, first)
        out[doc[first]] += sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1)
    return out


def fit(rows_: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> tuple[float, np.ndarray]:
    """AdaGrad on the logistic loss over small batches. One class only, or no rows: a constant."""
    rng = np.random.Generator(np.random.PCG64(seed))
    table = np.zeros((WIDTH, 1 + RANK))
    n, good = len(labels), int(labels.sum())
    if not n or good in (0, n):
        return (0.0 if not n else 4.0 if good else -4.0), table
    table[:, 1:] = rng.normal(0, 0.02, (WIDTH, RANK))
    bias, past, past_bias = float(np.log(good / (n - good))), np.full_like(table, 1e-6), 1e-6
    weight = np.where(labels == 1, n / (2 * good), n / (2 * (n - good))) ** 0.5
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, 128):
            part = order[i : i + 128]
            key = np.concatenate([rows_[j][0] for j in part])
            val = np.concatenate([rows_[j][1] for j in part])
            doc = np.repeat(np.arange(len(part)), [len(rows_[j][0]) for j in part])
            x = table[key] * val[:, None]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            sums = np.add.reduceat(x, first)
            z = bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - np.add.reduceat(x[:, 1:] ** 2, first)).sum(axis=1)
            err = (1 / (1 + np.exp(-z)) - labels[part]) * weight[part] / len(part)
            each = (err[doc] * val)[:, None] * np.concatenate((np.ones((len(doc), 1)), sums[doc, 1:] - x[:, 1:]), axis=1)
            used, where = np.unique(key, return_inverse=True)
            grad = np.zeros((len(used), 1 + RANK))
            np.add.at(grad, where, each)
            grad += 1e-5 * table[used]
            past[used] += grad**2
            table[used] -= 0.08 * grad / np.sqrt(past[used])
            past_bias += err.sum() ** 2
            bias -= 0.08 * err.sum() / np.sqrt(past_bias)
    return bias, table


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(3)) == 1


def train(df: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality", chars: str = "n_chars") -> tuple[float, np.ndarray]:
    """Fit on at most `sample` labelled ids, those of the smallest hashes; held-out ids are never used.

    An id with several labels counts with the smallest; an id with several texts with the one of the smallest hash, so
    repeated rows add nothing. Null ids and null labels are left out; null texts are empty, null lengths unknown. No
    usable row gives a constant score of 0.5, one class only a constant towards it. Other columns are not read.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    one = usable.groupBy(key).agg(F.min(label).alias("_label"))
    chosen = one.orderBy(F.xxhash64(key), key).limit(sample)
    meta = F.col(chars).try_cast("double") if chars in df.columns else F.lit(None).cast("double")
    found = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"), meta.alias("_chars")).join(F.broadcast(chosen.withColumnRenamed(key, "_id")), "_id")  # at most `sample` ids
    first = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"), F.col("_chars").alias("n"), F.col("_label").alias("y")))
    found = found.groupBy("_id").agg(first.alias("_r")).select("_id", F.col("_r.t").alias("_text"), F.col("_r.n").alias("_chars"), F.col("_r.y").alias("_label"))

    def run(batches):
        for batch in rows.slices(batches, "_text"):
            data, offsets = text_bytes(batch, "_text")
            doc, k, v = features(data, offsets, batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False))
            ends = np.searchsorted(doc, np.arange(len(offsets)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(3).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(k, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.astype(np.float32)))],
                names=["id", "label", "k", "v"],
            )

    got = sorted(rows.arrow_map(found, run, "id string, label int, k array<int>, v array<float>").collect(), key=lambda r: (r["id"], r["k"]))
    return fit([(np.array(r["k"], np.int64), np.array(r["v"], float)) for r in got], np.array([r["label"] for r in got]))


def score(df: DataFrame, model: tuple[float, np.ndarray], *, key: str = "doc_id", text: str = "text", chars: str = "n_chars", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns: key, the columns in keep, score (0 to 1), predicted (1 if score >= 0.5), one row for each row of df.

    Null and empty texts get the score of a text without words; a null length is unknown. Rows are scored one by one,
    so null keys, ties and repeated rows need no rule; an empty table gives none. Columns of df named score or
    predicted are replaced, others travel under names of their own.
    """
    meta = F.col(chars).try_cast("double") if chars in df.columns else F.lit(None).cast("double")
    carried = [key, *(c for c in keep if c not in (key, "score", "predicted"))]
    place = f"c{carried.index(text)}" if text in carried else "_text"  # a text that is carried goes to the worker once
    bias, table = model
    small = (bias, table.astype(np.float32))
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], *[F.col(text).alias("_text")] * (text not in carried), meta.alias("_chars"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[: len(carried)]) + ", score double, predicted int"

    def run(batches):
        for batch in rows.slices(batches, place, rows.FINE):
            data, offsets = text_bytes(batch, place)
            doc, k, v = features(data, offsets, batch.column(batch.num_columns - 1).cast(pa.float64()).to_numpy(zero_copy_only=False))
            z = raw_scores(small, doc, k, v, len(offsets) - 1)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names[: len(carried)], "score", "predicted"])

    return rows.arrow_map(source, run, schema).toDF(*carried, "score", "predicted")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
