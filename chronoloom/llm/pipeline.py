"""A training corpus from `documents`: five stages, each one operator of this subpackage over all that came before.

Every stage takes extra columns of any name along, and an empty table, null values, empty and very long texts, ties and
repeated rows as its operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing, near_dedup, packing, quality_model, rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more).

    Null and empty texts are scored as texts without words; equal rows share their fate; null ids are scored, too.
    """
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    work, own, back = rows.masked(docs)
    chars = {"chars": own("n_chars")} if "n_chars" in docs.columns else {}
    scored = quality_model.score(work, model, key=own("doc_id"), text=own("text"), keep=tuple(work.columns), **chars)
    return scored.filter("predicted = 1").select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines removed but for their first bearer; a document that loses all its lines goes.

    Three sites make a line boilerplate, two a line of over 50 words. Null and empty texts lose nothing and stay, as do
    blank lines; rows that share an id lose the same lines; n_chars is renewed where lines went.
    """
    work, own, back = rows.masked(docs)
    text, chars = own("text"), own("n_chars")
    done = line_dedup.dedup_lines(work, long_sites=line_dedup.LONG_SITES, key=own("doc_id"), text=text, site=own("source"))
    blank = F.trim(F.coalesce(text, F.lit("")), F.lit(rows.SPACES)) == ""
    kept = done.filter(~((F.col("n_removed") > 0) & blank))
    length = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(chars))
    return kept.withColumn(chars, length).select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows that repeat an id with the same text, one stays (the smallest by its other columns); rows of one id with
    different texts stay or go together. Texts without words are copies of nothing; rows with a null id all stay.
    """
    work, own, back = rows.masked(docs)
    key, text = own("doc_id"), own("text")
    gone = near_dedup.near_duplicates(work, key=key, text=text).filter("NOT kept").select(key).distinct()
    kept = work.join(gone, key, "left_anti")
    same = [key, F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(7), text).alias("_b")]
    named = kept.filter(F.col(key).isNotNull())
    again = rows.checkpoint(named.groupBy(*same).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, "_a", "_b"))
    if again.isEmpty():
        return kept.select(*back)
    hashed = kept.select("*", *same[1:])
    rest = [c for c in work.columns if c != text]
    one = hashed.join(again, [key, "_a", "_b"], "left_semi").groupBy(key, "_a", "_b").agg(F.min_by(F.struct(*work.columns), F.to_json(F.struct(*rest))).alias("_r")).select("_r.*")
    return hashed.join(again, [key, "_a", "_b"], "left_anti").select(*work.columns).unionByName(one).select(*back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mix takes them, a null source being one."""
    work, own, back = rows.masked(docs)
    return mixing.mix(work, key=own("doc_id"), text=own("text"), source=own("source")).select(*back)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids; null and empty texts give their end token."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("mixing", mixture),
    ("packing", sequences),
]

#: The first stage is a trained model; tests compare the stages with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = rows.checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
