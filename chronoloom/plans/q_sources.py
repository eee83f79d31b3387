"""Sources, sinks and streams: each query writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import batch as B
from ..operators import partition as P
from ..operators import windows as W
from ..sources import readers as R
from ..sources.adapters import Tables
from ..streaming import replay as L
from .define import EDGES, NODES, query
from .q_batch import NEGATIVES
from .q_partition import FEATS
from .q_stats import BOOK, SLIDING, graph
from .q_windows import REORDER, permutation


def folder(t: Tables, name: str) -> str:
    return L.scratch(t.spark, name)


@query("scan_edges_csv", EDGES + " SELECT src, dst, ts AS time, eid % 3 AS ext_roll FROM e")
def _(t: Tables):
    path = folder(t, "csv")
    t.purchase_edges().select("src", "dst", F.col("ts").alias("time"), (F.col("eid") % 3).alias("ext_roll")).write.csv(path, header=True)
    return R.scan_edges_csv(t.spark, path)


def text_edges(t: Tables, name: str, *columns: str):
    """The edges as one text file with two lines before them."""
    path = folder(t, name)
    lines = t.purchase_edges().select(F.col("eid").alias("_k"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))
    head = t.spark.createDataFrame([(-2, "% asym positive"), (-1, "% edges")], "_k long, value string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("_k").select("value").write.text(path)  # the format is one file
    return path


@query("scan_edges_ws", EDGES + " SELECT src, dst, 1.0::DOUBLE AS w, ts AS time FROM e")
def _(t: Tables):
    return R.scan_edges_ws(t.spark, text_edges(t, "ws3", "src", "dst", "ts"))


@query("scan_edges_weighted", EDGES + " SELECT src, dst, w, ts AS time FROM e")
def _(t: Tables):
    return R.scan_edges_ws(t.spark, text_edges(t, "ws4", "src", "dst", "w", "ts"))


@query("scan_snapshots", SLIDING + " SELECT snap::INT AS snap, src, dst, w FROM sn")
def _(t: Tables):
    path = text_edges(t, "snaps", "src", "dst", "w", "ts")
    return R.scan_snapshots(t.spark, path, R.Preset("purchases", 20, 2, r"\s+", 1, 3)).select("snap", "src", "dst", "w")


@query("dataset_presets", "SELECT * FROM (VALUES ('ia-slashdot-reply-dir', 200, 30, FALSE), ('rec-amazon-ratings', 100, 30, TRUE), ('rec-amz-Books', 100, 0, FALSE), ('soc-bitcoin', 100, 10, TRUE), ('soc-flickr-growth', 100, 30, TRUE), ('soc-youtube-growth', 100, 20, TRUE), ('stackexch', 200, 30, FALSE)) v(name, \"window\", lags, enabled)")
def _(t: Tables):
    return t.spark.createDataFrame([(p.name, p.window, p.lags, p.enabled) for p in R.PRESETS], "name string, window int, lags int, enabled boolean")


@query("source_discovery", "SELECT * FROM (VALUES ('a', 'edges.csv'), ('b', 'b.edges'), ('c', NULL)) v(name, found)")
def _(t: Tables):
    root = folder(t, "sets")
    one = t.spark.createDataFrame([("1,2,3,0",)], "value string").coalesce(1)
    one.write.text(f"{root}/a/edges.csv")
    one.write.text(f"{root}/b/b.edges")
    found = [(n, R.discover(t.spark, root, n)) for n in "abc"]
    return t.spark.createDataFrame([(n, p and p.rsplit("/", 1)[1]) for n, p in found], "name string, found string")


@query("scan_features", NODES + FEATS + " SELECT node, x0::FLOAT::DOUBLE AS x0, x3::FLOAT::DOUBLE AS x3, 4::BIGINT AS width, 172::BIGINT AS drawn FROM ft")
def _(t: Tables):
    from .q_partition import node_features

    path, nodes = folder(t, "features"), graph(t)[1].select("node")
    node_features(t, nodes).write.parquet(path)
    x = R.scan_features(t.spark, path, nodes).select("node", F.get("x", F.lit(0)).cast("double").alias("x0"), F.get("x", F.lit(3)).cast("double").alias("x3"), F.size("x").cast("long").alias("width"))
    drawn = R.scan_features(t.spark, f"{path}-absent", nodes).select("node", F.size("x").cast("long").alias("drawn"))
    return x.join(drawn, "node")


@query("load_dataset", EDGES + " SELECT eid, src, dst, ts FROM e")
def _(t: Tables):
    path = folder(t, "set")
    R.save_dataset({"edges": t.purchase_edges()}, path)
    return R.load_dataset(t.spark, path)["edges"].select("eid", "src", "dst", "ts")


def chunks(t: Tables):
    e, p = graph(t)
    return W.subchunk(e.join(p.withColumnRenamed("node", "dst"), "dst").withColumn("slot", F.expr("ts div 365")), 200)


CHUNKS = NODES + ", c AS (SELECT eid, p.part, ts // 365 AS slot, (row_number() OVER (PARTITION BY p.part, ts // 365 ORDER BY p.cluster, ts, eid) - 1) // 200 AS sub FROM e JOIN p ON p.node = dst)"


@query("sink_chunks", CHUNKS + " SELECT eid, part::INT AS part, slot::INT AS slot, sub FROM c")
def _(t: Tables):
    path = folder(t, "chunks")
    R.sink_chunks(chunks(t), path)
    return R.scan_chunks(t.spark, path).select("eid", "part", "slot", "sub")


@query("scan_chunks", CHUNKS + " SELECT eid, sub FROM c WHERE part = 1 AND slot BETWEEN 4 AND 6")
def _(t: Tables):
    path = folder(t, "chunks")
    R.sink_chunks(chunks(t), path)
    return R.scan_chunks(t.spark, path, part=1, slots=(4, 6)).select("eid", "sub")


@query("sink_batches", NODES + " SELECT (dst % 4)::INT AS part, 'pos' AS kind, eid FROM e UNION ALL SELECT (dst % 4)::INT, 'neg', eid FROM e, (SELECT unnest(range(2)))")
def _(t: Tables):
    path = folder(t, "batches")
    e = t.purchase_edges().withColumn("part", F.col("dst") % 4)
    negative = B.negatives(e, num_set=2, part="part").select("part", F.lit("neg").alias("kind"), "neg_set", "eid", "node")
    positive = e.select("part", F.lit("pos").alias("kind"), F.lit(-1).alias("neg_set"), "eid", F.col("src").alias("node"))
    R.sink_batches(positive.unionByName(negative), path)
    return t.spark.read.parquet(path).select("part", "kind", "eid")


@query("sink_neg_batches", NODES + NEGATIVES + " SELECT x.part::INT AS part, s::INT AS neg_set, eid, pool.dst AS node FROM x, (SELECT unnest(range(8)) AS s) JOIN pool ON pool.part = x.part AND pool.idx = (eid * 2654435761 + s * 40503) % n")
def _(t: Tables):
    path = folder(t, "negatives")
    e = t.purchase_edges().withColumn("part", F.col("dst") % 4)
    R.sink_batches(B.negatives(e, num_set=8, part="part").withColumn("kind", F.lit("neg")), path)
    return t.spark.read.parquet(path).select("part", "neg_set", "eid", "node")


@query("sink_meta", EDGES + ", b AS (SELECT i::INT AS slot, 1000 + 500 * i AS ts_start, 1500 + 500 * i AS ts_end FROM (SELECT unnest(range(6)) AS i)) SELECT slot, ts_start::BIGINT AS ts_start, ts_end::BIGINT AS ts_end, count(e.eid)::BIGINT AS n FROM b LEFT JOIN e ON ts >= ts_start AND ts < ts_end GROUP BY 1, 2, 3")
def _(t: Tables):
    path = folder(t, "meta")
    bounds = [1000 + 500 * i for i in range(7)]
    e, perm = permutation(t)
    R.sink_meta(perm, t.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))], "slot int, ts_start long, ts_end long"), path)
    counts = W.slot_assign(e, bounds).groupBy(F.col("slot").cast("int").alias("slot")).agg(F.count("*").alias("n"))
    return t.spark.read.parquet(f"{path}/slots").join(counts, "slot", "left").select("slot", "ts_start", "ts_end", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("sink_context", BOOK + FEATS + " SELECT 'node' AS kind, part::INT AS part, node AS id, loc, round(x0, 6) AS x FROM book JOIN ft USING (node) UNION ALL SELECT 'edge', p.part::INT, eid, ts, w FROM e JOIN p ON p.node = dst")
def _(t: Tables):
    from .q_partition import node_features

    path = folder(t, "context")
    e, p = graph(t)
    R.sink_context(P.partition_book(e, p), node_features(t, p.select("node")), P.edge_owner(e, p), path)
    nodes = t.spark.read.parquet(f"{path}/nodes").select(F.lit("node").alias("kind"), "part", F.col("node").alias("id"), "loc", F.round(F.get("x", F.lit(0)), 6).alias("x"))
    return nodes.unionByName(t.spark.read.parquet(f"{path}/edges").select(F.lit("edge").alias("kind"), "part", F.col("eid").alias("id"), F.col("ts").alias("loc"), F.col("w").alias("x")))


@query("sink_perm", REORDER + " SELECT new_id, node FROM pm")
def _(t: Tables):
    path = folder(t, "meta")
    e, perm = permutation(t)
    R.sink_meta(perm, t.spark.createDataFrame([(0, 0, 1)], "slot int, ts_start long, ts_end long"), path)
    return t.spark.read.parquet(f"{path}/perm")


@query("scan_log", EDGES + " SELECT (ts // 200)::INT AS epoch, sum(w) AS train_loss, count(*)::DOUBLE AS eval_loss, 0.25::DOUBLE AS comm_time FROM e GROUP BY 1")
def _(t: Tables):
    path = folder(t, "log")
    rows = t.purchase_edges().groupBy(F.expr("ts div 200").alias("epoch")).agg(F.sum("w").alias("train_loss"), F.count("*").cast("double").alias("eval_loss"), F.lit(0.25).alias("comm_time"))
    R.log_line(rows).write.text(path)
    return R.scan_log(t.spark, path)


@query("inspect_batch", EDGES + ", c AS (SELECT count(*)::BIGINT AS n, count(DISTINCT dst)::BIGINT AS d FROM e), f AS (SELECT unnest(['dst_local', 'n', 'indices', 'ts', 'eid', 'dt']) AS field) SELECT field, CASE WHEN field IN ('dst_local', 'n') THEN 'bigint' ELSE 'array<bigint>' END AS type, CASE WHEN field IN ('dst_local', 'n') THEN d ELSE n END AS entries, CASE WHEN field IN ('dst_local', 'n') THEN d ELSE n END * 8 / 1e6::DOUBLE AS mb, TRUE AS wide FROM f, c")
def _(t: Tables):
    return R.inspect_batch(B.build_csc(t.purchase_edges().select(F.col("dst").alias("dst_local"), "ts", F.lit(0).cast("long").alias("dt"), "eid", F.col("src").alias("src_local"))))


@query("checkpoint_model", "SELECT i, j, ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE AS w FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(3)) AS j)")
def _(t: Tables):
    path = folder(t, "model")
    R.save_parameters({"w": V.weights(4, 3)}, t.spark, path)
    w = R.load_parameters(t.spark, path)["w"]
    return t.spark.createDataFrame([(i, j, x) for i, row in enumerate(w) for j, x in enumerate(row)], "i long, j long, w double")


# Streams: the events replayed in several micro-batches.


def replayed(t: Tables):
    path = folder(t, "replay")
    L.stage(t.table("events").select("event_id", "ts", "user_id", "event_type", "value", "props"), path, 4)
    return L.event_stream(t.spark, path)



@query("stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 day, ts))::BIGINT AS begin, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def _(t: Tables):
    got = L.drain(L.windowed(replayed(t), "1 day"), "update", "window")
    return got.select(F.unix_micros("window.start").alias("begin"), "n", F.round("value", 4).alias("value"))


@query("stream_sliding", "SELECT epoch_us(b)::BIGINT AS begin, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM (SELECT value, unnest([time_bucket(INTERVAL 12 hour, ts), time_bucket(INTERVAL 12 hour, ts) - INTERVAL 12 hour]) AS b FROM events) GROUP BY 1")
def _(t: Tables):
    got = L.drain(L.windowed(replayed(t), "1 day", "12 hours"), "update", "window")
    return got.select(F.unix_micros("window.start").alias("begin"), "n", F.round("value", 4).alias("value"))


@query("stream_mailbox", "SELECT user_id AS node, event_id AS pos, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 10 AS slot FROM events")
def _(t: Tables):
    m = replayed(t).select(F.col("user_id").alias("node"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("pos"))
    return L.drain(L.mailbox_stream(m, 10)).select("node", "pos", "slot")
