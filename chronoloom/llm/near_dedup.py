"""MinHash near-dedup (operator 10): fast similarity sketching, banding, exact verification, components.

1. One pass over the texts: shingle set, its fingerprint, its sketch, a key for each band.
2. Equal sets form a class with the smallest id as representative; only representatives go on.
3. Buckets of equal band keys. Each bucket's smallest id is compared with its members (a star, not all pairs), links
   are confirmed on the full sets, and components are built from them.
4. Buckets whose members still lie in several components: members outside the bucket's largest component are compared
   with those of all other components, pair by pair in small buckets, block against block in larger ones. So every pair
   that shares a bucket is either confirmed, refuted, or connected already, and a bucket whose members are connected but
   for a few makes rows in proportion to its members.
5. Every row gets its class's component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows
from .shingles import WORDS, Sketcher, fingerprint, links, shingle_set

PERCENT = 75
#: At a similarity of 0.75 a pair shares none of the bands with probability (1 - 0.75**6)**60, below 1 in 100,000.
BANDS = 60
ROWS = 6
#: Buckets of up to SMALL members are compared as pairs, larger ones in blocks of BLOCK members or BLOCK_SHINGLES shingles.
SMALL = 12
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
#: Ids up to which the texts of candidates are found by a broadcast of these ids; beyond, by a shuffle.
BROADCAST_IDS = 400_000


def sketches(df: DataFrame, *, key: str, text: str, bands: int, rows_: int, words: int) -> DataFrame:
    """id, n (set size), f0, f1 (fingerprint of the set), bands (null for an empty set)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        sketcher = Sketcher(bands * rows_)
        for batch in rows.slices(batches, text):
            sizes, f0, f1, flat, ends = [], [], [], [], [0]
            for data in rows.utf8_column(batch, text).to_pylist():
                s = shingle_set(data, words)
                a, b = fingerprint(s)
                sizes.append(len(s))
                f0.append(a)
                f1.append(b)
                if len(s):
                    flat.append(sketcher.bands(s, rows_))
                ends.append(ends[-1] + bands * bool(len(s)))
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), keys], names=["id", "n", "f0", "f1", "bands"])

    return rows.arrow_map(df.select(F.col(key).alias("id"), text), run, f"id {kind}, n long, f0 long, f1 long, bands array<long>")


def texts_of(ids: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """id, t: the texts of these ids (distinct); repeated rows count once."""
    n = ids.count()
    wanted = texts.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi")
    return wanted.groupBy("id", F.xxhash64(text).alias("_h")).agg(F.first(text).alias("t")).select("id", "t")


def confirm(pairs: DataFrame, texts: DataFrame, *, text: str, percent: int, words: int) -> DataFrame:
    """Of pairs(a, b) those whose full shingle sets meet the threshold."""
    pairs = rows.checkpoint(pairs)
    ids = rows.checkpoint(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.lit(1).alias("one")).select("id"))
    wanted = rows.checkpoint(texts_of(ids, texts, text))
    both = pairs.join(wanted.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(wanted.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches):
        last, own = None, None
        for batch in rows.slices(batches, "tb"):
            good = []
            for ta, tb in zip(rows.utf8_column(batch, "ta"), rows.utf8_column(batch, "tb").to_pylist(), strict=True):
                ta = ta.as_py()
                if ta != last:
                    last, own = ta, shingle_set(ta, words)
                good.append(links(own, shingle_set(tb, words), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.arrow_map(both, run, f"a {kind}, b {kind}").distinct()


def confirm_blocks(members: DataFrame, bands: DataFrame, texts: DataFrame, *, text: str, percent: int, words: int, block: int = BLOCK) -> DataFrame:
    """Members of large mixed buckets (as of mixed_buckets): linked labels (a, b) of those outside the largest component
    and any others.

    Askers (those outside) and members are cut into blocks by hash, and every pair of their blocks is one task's group
    of at most some 2 * `block` documents: rows grow with askers * members / block, and with members alone where few
    ask. A pair that shares several buckets is compared in the first of them.
    """
    cut = lambda count, load: F.greatest(F.ceil(F.col(count) / block), F.ceil(F.col(load) / BLOCK_SHINGLES)).cast("int")
    spread = members.withColumns({"_na": cut("asks", "ask_load"), "_nr": cut("m", "load")})
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), n).cast("int")
    # One explode for both sides: a member is met by every block of askers, and an asker meets every block of members.
    met = F.transform(F.sequence(F.lit(0), F.col("_na") - 1), lambda i: F.struct(i.alias("i"), own(2, F.col("_nr")).alias("j"), F.lit(1).alias("side")))
    asks = F.when(F.col("label") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("_nr") - 1), lambda j: F.struct(own(1, F.col("_na")).alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    spots = F.explode(F.concat(met, F.coalesce(asks, F.array().cast("array<struct<i:int,j:int,side:int>>")))).alias("_x")
    spread = spread.select("bucket", "id", "n", "label", spots).select("bucket", "_x.i", "_x.j", "_x.side", "id", "n", "label")
    wanted = rows.checkpoint(texts_of(rows.checkpoint(members.select("id").distinct()), texts, text).join(bands.select("id", "bands"), "id"))
    kind = members.schema["label"].dataType.simpleString()

    def run(key, frame):
        import pandas as pd

        bucket = key[0]
        n, label, side = (frame[c].to_numpy() for c in ("n", "label", "side"))
        keys = np.stack(frame["bands"].to_list())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        big, small = np.maximum(n[left][:, None], n[right]), np.minimum(n[left][:, None], n[right])
        x, y = np.nonzero((label[left][:, None] != label[right]) & (small * 100 >= big * percent))
        if len(x):
            equal = keys[left[x]] == keys[right[y]]
            first = equal.argmax(axis=1)
            mine = keys[left[x], first] == bucket
            x, y = x[mine], y[mine]
        if not len(x):
            return pd.DataFrame({"a": label[:0], "b": label[:0]})
        docs = np.unique(np.concatenate((left[x], right[y])))
        sets = {d: shingle_set(frame["t"].iloc[d].encode(), words) for d in docs}
        lengths = np.array([len(sets[d]) for d in docs])
        where = np.unique(np.concatenate([sets[d] for d in docs]), return_inverse=True)[1]
        row = np.repeat(np.arange(len(docs)), lengths)
        order = np.argsort(where, kind="stable")
        where, row = where[order], row[order]
        both = np.zeros((len(docs), len(docs)), np.float32)
        for start in range(0, int(where[-1]) + 1, 4096):  # a slice of the shingles at a time
            lo, hi = np.searchsorted(where, (start, start + 4096))
            piece = np.zeros((len(docs), 4096), np.float32)
            piece[row[lo:hi], where[lo:hi] - start] = 1
            both += piece @ piece.T
        u, v = np.searchsorted(docs, left[x]), np.searchsorted(docs, right[y])
        inter = np.rint(both[u, v]).astype(np.int64)
        good = (100 * inter >= percent * (lengths[u] + lengths[v] - inter)) & (inter > 0)
        a, b = label[left[x[good]]], label[right[y[good]]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    grouped = spread.join(wanted, "id").select("bucket", "i", "j", "side", "id", "n", "label", "bands", "t")
    return grouped.groupBy("bucket", "i", "j").applyInPandas(run, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable over edges(a, b), for every id with an edge. Labels spread and jump."""
    both = rows.checkpoint(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    label = rows.checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("label").alias("m"))
        spread = label.join(near, label["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = label.select(F.col("id").alias("j"), F.col("label").alias("far"))
        new = rows.checkpoint(spread.join(jump, spread["label"] == jump["j"], "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if new.filter("old <> label").isEmpty():
            return new.select("id", "label")
        label = new.select("id", "label")


def merged(label: DataFrame, links_: DataFrame) -> DataFrame:
    """label(id, label) after links_(a, b) between labels; ids that label lacks are their own label."""
    top = rows.checkpoint(components(links_).select(F.col("id").alias("label"), F.col("label").alias("top")))
    known = label.join(top, "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    return rows.checkpoint(known.unionByName(top.select(F.col("label").alias("id"), F.col("top").alias("label")).join(label, "id", "left_anti")))


def mixed_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members (bucket, id, n, lead, label) of buckets in several components, with m and load (members and their
    shingles), main (label of the largest component), asks and ask_load (those outside it)."""
    of = members.join(label, "id", "left").select("bucket", "id", "n", "lead", F.coalesce("label", "id").alias("label"))
    per = of.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("l"))
    mixed = per.groupBy("bucket").agg(F.sum("c").alias("m"), F.sum("l").alias("load"), F.count("*").alias("_k"), F.max(F.struct("c", "l", "label")).alias("_m")).filter("_k > 1 AND m > 2")
    named = mixed.select("bucket", "m", "load", F.col("_m.label").alias("main"), (F.col("m") - F.col("_m.c")).alias("asks"), (F.col("load") - F.col("_m.l")).alias("ask_load"))
    return rows.checkpoint(of.join(named, "bucket"))


def near_duplicates(df: DataFrame, percent: int = PERCENT, *, bands: int = BANDS, band_rows: int = ROWS, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: key, n_shingles, component_id, kept (the row's id is its component's smallest).

    Null and blank texts have no shingles and are linked with nothing. A null id cannot name a component: such a row
    is linked with nothing either, its component_id is null and it is kept. Rows that share an id are one document.
    Other columns of df are not carried. An empty table gives an empty result.
    """
    sk = rows.checkpoint(sketches(df, key=key, text=text, bands=bands, rows_=band_rows, words=words))
    named = sk.filter("id IS NOT NULL AND n > 0")
    classes = rows.checkpoint(named.groupBy("f0", "f1").agg(F.min(F.struct("id", "n", "bands")).alias("r")).select("f0", "f1", "r.*"))
    spots = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = spots.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("m")).filter("m > 1").select("bucket", "lead")
    members = rows.checkpoint(spots.join(shared, "bucket").select("bucket", "id", "n", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")))
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("_text")).filter(F.col("id").isNotNull())
    options = {"text": "_text", "percent": percent, "words": words}
    fit = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  a link needs sizes this close
    stars = members.filter((F.col("id") != F.col("lead")) & fit(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    label = components(confirm(stars, texts, **options))
    rest = mixed_buckets(members, label)
    large = rest.filter(F.col("m") > SMALL)
    # What the stars left open.
    few = rest.filter((F.col("m") <= SMALL) & (F.col("id") != F.col("lead")))
    one, two = few.select("bucket", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la")), few.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    cross = one.join(two, "bucket").filter((F.col("la") < F.col("lb")) & fit(F.col("na"), F.col("nb"))).select("a", "b", "la", "lb").distinct()
    cross = rows.checkpoint(cross)
    found = confirm(cross.select("a", "b"), texts, **options)
    joined = found.join(cross, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    if not large.isEmpty():
        joined = joined.union(confirm_blocks(large, classes, texts, **options)).distinct()
    final = merged(label, joined)
    class_of = classes.join(final, "id", "left").select("f0", "f1", F.coalesce("label", "id").alias("component_id"))
    slim = sk.select("id", "n", "f0", "f1")
    out = slim.filter("id IS NOT NULL AND n > 0").join(class_of, ["f0", "f1"]).select("id", "n", "component_id")
    out = out.unionByName(slim.filter("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(rows.documents(spark, sf_dir))
