"""Line dedup (operator 7): distinct-site spread.

For every line hash a HyperLogLog sketch of its sites merges by aggregation. Sketches far from the threshold decide by
their estimate; lines near it get an exact distinct count. A line found on enough sites is cross-site boilerplate: its
first bearer (smallest id) keeps it, every other document loses it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows

MIN_SITES = 3
#: Sites for lines of more than LONG_WORDS words, where they have a threshold of their own (the pipeline).
LONG_SITES = 2
LONG_WORDS = 50
LG_K = 10
#: Standard errors of the sketch within which a line counts as near the threshold.
NEAR = 5
#: Keys of lines up to which they are broadcast, some 100 bytes each; more are joined by a shuffle.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(rows.SPACES))


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line: two hashes with seeds of their own."""
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(F.lit(7), _bare(line)).alias("b"))


def _line_rows(df: DataFrame, key: str, text: str, site: str, long_sites: int | None, long_words: int) -> DataFrame:
    """Not blank lines of df: _id, _h (hash of the whole text), _pos, _site, _long, line (its key)."""
    text_key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    lines = df.select(F.col(key).alias("_id"), text_key.alias("_h"), F.col(site).cast("string").alias("_site"), F.posexplode(_lines(F.col(text))).alias("_pos", "_l"))
    bare = _bare(F.col("_l"))
    lines = lines.filter(bare != "")
    long = F.lit(False)
    if long_sites is not None:
        long = (F.length(bare) > 2 * long_words) & (F.size(F.split(bare, rows.GAP, -1)) > long_words)
        lines = lines.withColumn("_long", long).withColumn("_site", F.when(F.col("_long"), F.coalesce(F.concat(F.lit("s"), "_site"), F.lit("n"))).otherwise(F.col("_site")))
    else:
        lines = lines.withColumn("_long", long)
    return lines.select("_id", "_h", "_pos", "_site", "_long", line_key(F.col("_l")).alias("line"))


def site_spread(df: DataFrame, min_sites: int = MIN_SITES, *, long_sites: int | None = None, long_words: int = LONG_WORDS, lg_k: int = LG_K, key: str = "doc_id", text: str = "text", site: str = "source") -> tuple[DataFrame, DataFrame]:
    """Lines (trimmed, not blank) on at least `min_sites` distinct sites: columns line (its key), keeper (smallest id);
    and the rows (_id, _h, _pos, line) of a few lines that are these and those whose sketch comes near.

    A null site is no site. With `long_sites`, lines of more than `long_words` words need that many sites instead, and
    for them null is a site of its own. A null id is never the keeper unless all bearers have null ids.

    Sketches merge by aggregation, one from each task for a hot line. Lines whose sketch lies within NEAR standard
    errors of the threshold are read again for their distinct (line, site) pairs, which merge in each task as well.
    """
    error = 1.04 / math.sqrt(1 << lg_k) * NEAR
    edges = lambda n: (min(n * (1 - error), n - 0.5), max(n * (1 + error), n + 0.5), n)
    low, high, need = (F.when(F.col("_long"), F.lit(y)).otherwise(F.lit(x)) for x, y in zip(edges(min_sites), edges(long_sites or min_sites)))
    lines = _line_rows(df, key, text, site, long_sites, long_words)
    spread = lines.groupBy("line", "_long").agg(F.count("_site").alias("_n"), F.hll_sketch_agg("_site", F.lit(lg_k)).alias("_sketch"), F.min("_id").alias("keeper"))
    spread = spread.filter(F.col("_n") >= need).select("line", "_long", "keeper", F.hll_sketch_estimate("_sketch").alias("_sites"))
    spread = rows.checkpoint(spread.filter(F.col("_sites") >= low))
    held = spread.select("line")
    few = held.count() <= BROADCAST_LINES
    here = rows.checkpoint(lines.join(F.broadcast(held) if few else held, "line", "left_semi"))
    near = spread.filter(F.col("_sites") <= high)
    exact = here.filter(F.col("_site").isNotNull()).groupBy("line", "_long", "_site").agg(F.lit(1).alias("_one"))
    exact = exact.join(near.select("line"), "line", "left_semi").groupBy("line", "_long").agg(F.count("*").alias("_n")).filter(F.col("_n") >= need).select("line")
    common = spread.filter(F.col("_sites") > high).select("line", "keeper").unionByName(near.join(exact, "line", "left_semi").select("line", "keeper"))
    return common, here.select("_id", "_h", "_pos", "line")


def dedup_lines(df: DataFrame, min_sites: int = MIN_SITES, *, long_sites: int | None = None, long_words: int = LONG_WORDS, lg_k: int = LG_K, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Columns of df with the text's boilerplate lines removed, then n_lines, n_removed, removed (line numbers from 0).

    Lines are split at \\n and compared without white space around them; blank lines never count. Null and empty
    texts stay as they are, with 0 lines. Whether a line goes depends on it and the row's id alone, so repeated rows
    and rows that share an id lose the same lines, and the keeper's repeats of its own line stay; a row with a null id
    loses every line that has a keeper. An empty table gives none. Columns of df with one of the new names are replaced.
    """
    df = df.drop(*(c for c in ("n_lines", "n_removed", "removed") if c not in (key, text, site)))
    work, own, back = rows.masked(df)
    common, here = site_spread(work, min_sites, long_sites=long_sites, long_words=long_words, lg_k=lg_k, key=own(key), text=own(text), site=own(site))
    common = rows.checkpoint(common.filter("keeper IS NOT NULL"))
    few = common.count() <= BROADCAST_LINES
    lost = here.join(F.broadcast(common) if few else common, "line").filter(~F.col("keeper").eqNullSafe(F.col("_id")))
    lost = lost.groupBy("_id", "_h").agg(F.array_sort(F.collect_set("_pos")).alias("_lost"))
    text_key = F.struct(F.xxhash64(own(text)).alias("a"), F.xxhash64(F.lit(7), own(text)).alias("b"))
    joined = work.withColumn("_k", text_key).join(lost, (F.col("_k") == F.col("_h")) & F.col(own(key)).eqNullSafe(F.col("_id")), "left")
    body = F.col(own(text))
    split = joined.select(*work.columns, F.coalesce("_lost", F.array().cast("array<int>")).alias("removed"), _lines(body).alias("_lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed"), lambda i: F.get("_lines", i))
    kept = F.when(F.size("removed") == 0, body).otherwise(F.array_join(kept, "\n"))
    count = F.size(F.filter("_lines", lambda x: _bare(x) != "")).cast("long")
    done = [kept.alias(text) if c == text else x for c, x in zip(df.columns, back, strict=True)]
    return split.select(*done, count.alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(rows.documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.col("removed").cast("string").alias("removed"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP7_SQL = f"""
WITH l AS (SELECT d.doc_id, d.source, x.i - 1 AS i, x.line FROM documents d,
             unnest(list_transform(string_split(coalesce(d.text, ''), chr(10)), lambda v, k: {{'i': k, 'line': v}})) u(x)),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
c AS (SELECT bare, min(doc_id) AS keeper FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
j AS (SELECT b.*, c.bare IS NOT NULL AND b.doc_id <> c.keeper AS gone FROM b LEFT JOIN c ON b.bare = c.bare)
SELECT doc_id, count(*) FILTER (bare <> '')::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  '[' || coalesce(string_agg(i::VARCHAR, ', ' ORDER BY i) FILTER (gone), '') || ']' AS removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5
FROM j GROUP BY doc_id
"""
