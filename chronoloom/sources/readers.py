"""Readers and writers of edge files, datasets, chunks and logs. Paths are any that Spark can read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src LONG, dst LONG, time LONG, ext_roll LONG"


@dataclass(frozen=True)
class Preset:
    """How a snapshot data set is read and cut."""

    name: str
    window: int
    skiprows: int
    sep: str
    skiptime: int
    lags: int
    enabled: bool = True


#: The declared data sets.
PRESETS = (
    Preset("ia-slashdot-reply-dir", 200, 2, r"\s+", 1, 30, False),
    Preset("rec-amazon-ratings", 100, 2, ",", 1, 30),
    Preset("rec-amz-Books", 100, 0, ",", 0, 0, False),
    Preset("soc-bitcoin", 100, 0, r"\s+", 1, 10),
    Preset("soc-flickr-growth", 100, 1, r"\s+", 1, 30),
    Preset("soc-youtube-growth", 100, 2, r"\s+", 1, 20),
    Preset("stackexch", 200, 2, r"\s+", 1, 30, False),
)


def exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file systems, so that any store's paths work."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, time, ext_roll from a CSV with a header; unreadable fields are null."""
    return spark.read.schema(EDGE_SCHEMA).csv(path, header=True)


def _lines(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """Lines of text files without the first `skip` of each. These are found by offset, so that files stay splittable."""
    lines = spark.read.text(path)
    if not skip:
        return lines
    # Lines of a file's first block carry rising numbers; the head is a file's `skip` smallest.
    here = lines.select("value", F.col("_metadata.file_path").alias("_f"), (F.col("_metadata.file_block_start") == 0).alias("_first"), F.monotonically_increasing_id().alias("_i"))
    begin = here.filter("_first").groupBy("_f").agg(F.min("_i").alias("_b"))  # a row for each file
    # Null rather than filtered at once: what follows then depends on the join and is not evaluated on lines before it.
    value = F.when(F.col("_first") & (F.col("_i") < F.col("_b") + skip), F.lit(None)).otherwise(F.col("value"))
    return here.join(begin, "_f", "left").select(value.alias("value")).filter("value IS NOT NULL")


def scan_edges_ws(spark: SparkSession, path: str, skip: int = 2, sep: str = r"\s+") -> DataFrame:
    """src, dst, w, time from lines of three columns (src, dst, time; w is 1) or four (src, dst, w, time)."""
    part = F.filter(F.split(F.trim("value"), sep), lambda x: x != "")
    rows = _lines(spark, path, skip).filter(F.trim("value") != "").withColumn("_p", part).filter(F.size("_p") >= 2)
    n = F.size("_p")
    field = lambda i: F.get("_p", F.lit(i))
    # Raised where the columns are made, so that only lines that are kept are judged.
    other = F.raise_error(F.lit("edge lines have three or four columns")).cast("string")
    w = F.when(n == 4, field(2)).when(n == 3, F.lit("1")).otherwise(other)
    return rows.select(field(0).cast("long").alias("src"), field(1).cast("long").alias("dst"), w.cast("double").alias("w"), F.when(n == 4, field(3)).otherwise(field(2)).cast("double").cast("long").alias("time"))


def scan_snapshots(spark: SparkSession, path: str, preset: Preset) -> DataFrame:
    from ..operators.windows import sliding_snapshots

    edges = scan_edges_ws(spark, path, preset.skiprows, preset.sep).withColumnRenamed("time", "ts")
    return sliding_snapshots(edges, preset.window, preset.lags, skip=preset.skiptime)


def discover(spark: SparkSession, root: str, name: str) -> str | None:
    """edges.csv of a data set's folder, else <name>.edges, else None."""
    for path in (f"{root}/{name}/edges.csv", f"{root}/{name}/{name}.edges"):
        if exists(spark, path):
            return path
    return None


def scan_features(spark: SparkSession, path: str | None, nodes: DataFrame, d: int = 172, seed: int = 0) -> DataFrame:
    """node, x from Parquet; without a file, normal numbers that depend on the node alone (booleans become 0 and 1)."""
    if path and exists(spark, path):
        return spark.read.parquet(path).select("node", F.col("x").cast("array<float>").alias("x"))
    unit = lambda i, k: (F.pmod(F.xxhash64(F.lit(seed), "node", F.lit(i), F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    normal = [F.sqrt(-2 * F.ln(unit(i, 0))) * F.cos(unit(i, 1) * 6.283185307179586) for i in range(d)]
    return nodes.select("node", F.array(*normal).cast("array<float>").alias("x"))


def save_dataset(tables: dict[str, DataFrame], root: str, mode: str = "error") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{root}/{name}")


def load_dataset(spark: SparkSession, root: str, names: tuple[str, ...] = ("edges", "nodes")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names if exists(spark, f"{root}/{n}")}


def sink_chunks(chunks: DataFrame, path: str, mode: str = "error") -> None:
    """One folder for each (part, slot); rows of a chunk lie together, sorted by sub-chunk."""
    chunks.repartition("part", "slot").sortWithinPartitions("part", "slot", "sub").write.mode(mode).partitionBy("part", "slot").parquet(path)


def scan_chunks(spark: SparkSession, path: str, part: int | None = None, slots: tuple[int, int] | None = None) -> DataFrame:
    """Chunks with partition pruning by part and slot."""
    df = spark.read.parquet(path)
    if part is not None:
        df = df.filter(F.col("part") == part)
    return df if slots is None else df.filter(F.col("slot").between(*slots))


def sink_batches(batches: DataFrame, path: str, mode: str = "error") -> None:
    """batches(part, kind, neg_set, ...): folders by part and kind ('pos' or 'neg')."""
    batches.write.mode(mode).partitionBy("part", "kind").parquet(path)


def sink_context(book: DataFrame, node_feat: DataFrame, edges: DataFrame, path: str, mode: str = "error") -> None:
    """Per part the features of its stored nodes, and the edges that it owns."""
    book.join(node_feat, "node").write.mode(mode).partitionBy("part").parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("part").parquet(f"{path}/edges")


def sink_meta(perm: DataFrame, slots: DataFrame, path: str, mode: str = "error") -> None:
    perm.write.mode(mode).parquet(f"{path}/perm")
    slots.write.mode(mode).parquet(f"{path}/slots")


def parse_chunk_name(name: Column) -> tuple[Column, Column]:
    pattern = r"slot_([0-9]+)_sub_([0-9]+)"
    return F.regexp_extract(name, pattern, 1).cast("int"), F.regexp_extract(name, pattern, 2).cast("int")


LOG_FIELDS = ("epoch", "train_loss", "eval_loss", "comm_time")


def log_line(df: DataFrame) -> DataFrame:
    """One text line for each epoch: name=>value pairs."""
    return df.select(F.concat_ws(" ", *[F.concat(F.lit(f"{f}=>"), F.col(f).cast("string")) for f in LOG_FIELDS]).alias("value"))


def parse_log(lines: DataFrame) -> DataFrame:
    number = lambda f: F.regexp_extract("value", rf"{f}=>\s*([-+0-9.eE]+)", 1).cast("double")
    return lines.select(number("epoch").cast("int").alias("epoch"), *[number(f).alias(f) for f in LOG_FIELDS[1:]])


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path).filter(F.col("value").contains("epoch=>")))


def inspect_batch(df: DataFrame) -> DataFrame:
    """Field by field: type, rows, mean entries of arrays, approximate MB, and a warning for 8-byte numbers."""
    n = df.agg(*[F.sum(F.size(f.name) if "array" in f.dataType.simpleString() else F.lit(1)).alias(f.name) for f in df.schema.fields]).first()
    rows = []
    for f in df.schema.fields:
        kind, entries = f.dataType.simpleString(), int(n[f.name] or 0)
        width = 8 if any(k in kind for k in ("bigint", "double")) else 4
        rows.append((f.name, kind, entries, entries * width / 1e6, width == 8))
    return df.sparkSession.createDataFrame(rows, "field string, type string, entries long, mb double, wide boolean")


def save_parameters(weights: dict[str, list[list[float]]], spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    """Model weights as one row for each matrix row."""
    rows = [(k, i, [float(x) for x in row]) for k, w in weights.items() for i, row in enumerate(w)]
    spark.createDataFrame(rows, "name string, i int, row array<double>").coalesce(1).write.mode(mode).parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict[str, list[list[float]]]:
    out: dict[str, list[list[float]]] = {}
    for r in spark.read.parquet(path).orderBy("name", "i").collect():  # weights of a small model
        out.setdefault(r["name"], []).append(r["row"])
    return out
