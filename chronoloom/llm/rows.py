"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that separate words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Text bytes of a slice whose arrays take some hundred times as much.
FINE = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1))


def utf8_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as binary, nulls as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        return pa.array([b""] * len(col), pa.large_binary())
    return col.cast(pa.large_binary()).fill_null(b"")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about `limit` text bytes (one row at least), which bounds a worker's arrays."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        lens = [0] * len(col) if pa.types.is_null(col.type) else pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lens):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 1
        if start < len(lens):
            yield batch.slice(start)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder that all executors share, the one in spark.checkpoint.dir.

    Where the session names none, a local master (tests) gets a folder of its own; a cluster is refused, since each of
    its executors would write to its own disk.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def masked(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], list[Column]]:
    """The same rows with columns c0, c1, ..., so that no column of an operator's own (_x) clashes with one of df's.

    Also the new name of an old column, and the columns that bring the old names back.
    """
    names = df.columns
    new = [f"c{i}" for i in range(len(names))]
    return df.toDF(*new), lambda c: new[names.index(c)], [F.col(n).alias(c) for n, c in zip(new, names, strict=True)]


def release() -> None:
    """Gives what this process has freed back to the system; Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def small_table(spark: SparkSession, values: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A table of the driver's rows, read by the JVM as Arrow. Given as a list they would start a second set of Python
    workers on each executor."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([v[i] for v in values], f.type) for i, f in enumerate(arrow)], schema=arrow), fields)
