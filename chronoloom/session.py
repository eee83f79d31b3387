"""Session settings that the library expects, and the cut of lineage in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Files of a checkpoint go when no plan refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(master: str = "local[8]", partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("chronoloom")
    for key, value in (CONF | more).items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where the session names none, a local master gets a folder of its own; a cluster is refused, since each of its
    executors would write to its own disk.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not known.isDefined():
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def pack(df: DataFrame) -> DataFrame:
    """cut_lineage() of a large table, in a fifth of the disk: as compressed Parquet. Columns of plain types only.

    The files lie in the folder of the checkpoint of an empty table that the plan refers to, so they go when it goes.
    Shuffle files of the plan behind are of no more use; Spark removes them when the driver collects its garbage.
    """
    spark = df.sparkSession
    mark = cut_lineage(spark.range(1))
    path = f"{mark._jdf.logicalPlan().rdd().getCheckpointFile().get()}/rows"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    none = mark.filter("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return spark.read.schema(df.schema).parquet(path).unionByName(none)
