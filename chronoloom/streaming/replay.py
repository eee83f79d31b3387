"""Structured Streaming forms of the state operators: windows with a watermark, and mailboxes as keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: beside the checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a staged file at which a replay gets more pieces than asked for.
PIECE_ROWS = 2_000_000


def stage(events: DataFrame, path: str, pieces: int) -> None:
    """A replay of a finished table: files of consecutive time, written one after the other, oldest first.

    A piece is one file, however many tasks read the table: a stream takes its files by their age, and two files of one
    piece would hold the same stretch of time. Large tables get more pieces.
    """
    spark = events.sparkSession
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    pieces = max(pieces, -(-events.count() // PIECE_ROWS))
    cuts = events.agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], 10_000)).first()[0] or [] if pieces > 1 else []
    cuts = sorted(set(cuts))
    # Null times come last.
    piece = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= at))
    parts = scratch(spark, "pieces")
    events.withColumn("_piece", F.when(at.isNull(), len(cuts)).otherwise(piece)).repartition(len(cuts) + 1, "_piece").write.partitionBy("_piece").parquet(parts)
    for (i,) in sorted(spark.read.parquet(parts).select("_piece").distinct().collect()):  # a row for each piece
        spark.read.schema(events.schema).parquet(f"{parts}/_piece={i}").repartition(1).write.mode("append").parquet(path)
    remove(spark, parts)


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Files of events as a stream, one micro-batch for each few files, oldest first."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events and value by window; windows close when the watermark passes them."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Process all that is there and stop. Rows go to {folder}/rows with their micro-batch as micro_batch; a later run with
    the same folder goes on from the state in {folder}/state."""

    def keep(df: DataFrame, epoch: int) -> None:
        # Written again under its own name if a batch is repeated after a failure.
        df.write.mode("overwrite").parquet(f"{folder}/rows/micro_batch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def rows_of(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """What run() wrote; with a key, the last row of each (for update mode)."""
    rows = spark.read.parquet(f"{folder}/rows")
    if key is None:
        return rows.drop("micro_batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "micro_batch")]), "micro_batch").alias("_r")).select(key, "_r.*")


def drain(stream: DataFrame, mode: str = "append", key: str | None = None) -> DataFrame:
    """The rows of one run(); its folder is removed again."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")
    run(stream, folder, mode)
    rows = cut_lineage(rows_of(spark, folder, key))
    remove(spark, folder)
    return rows


def mailbox_stream(messages: DataFrame, size: int) -> DataFrame:
    """messages(node, ts, pos) in order: after each micro-batch, the ring positions that it wrote, by keyed state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def write(key, frames, state):
        cursor = state.get[0] if state.exists else 0
        frame = pd.concat(list(frames)).sort_values(["ts", "pos"])
        slots = [(cursor + i) % size for i in range(len(frame))]
        state.update((cursor + len(frame),))
        yield pd.DataFrame({"node": key[0], "ts": frame["ts"].to_numpy(), "pos": frame["pos"].to_numpy(), "slot": slots})

    return messages.groupBy("node").applyInPandasWithState(write, "node long, ts long, pos long, slot long", "cursor long", "append", GroupStateTimeout.NoTimeout)
