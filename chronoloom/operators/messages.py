"""Message passing along edges: norms, sums, attention, and the layers made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..session import cut_lineage


def gcn_norm(edges: DataFrame, kind: str = "graph") -> DataFrame:
    """edges with norm: 'graph' w / sqrt(in_w out_w), 'degree' 1 / sqrt(in out), 'block' w / sum of w at the target."""
    w = F.coalesce(F.col("w"), F.lit(1.0)) if "w" in edges.columns and kind != "degree" else F.lit(1.0)
    e = edges.withColumn("_w", w)
    into = e.groupBy("dst").agg(F.sum("_w").alias("_in"))
    joined = e.join(into, "dst")
    if kind == "block":
        norm = F.try_divide("_w", "_in")
    else:
        joined = joined.join(e.groupBy("src").agg(F.sum("_w").alias("_out")), "src")
        norm = F.try_divide(F.col("_w"), F.sqrt(F.col("_in") * F.col("_out")))
    return joined.withColumn("norm", V.nan_to_num(norm)).drop("_w", "_in", "_out")


def msg_sum(edges: DataFrame, features: DataFrame, d: int, scale: str = "norm") -> DataFrame:
    """dst, h: sum over edges of x(src) * scale; features(node, x) with d entries. One aggregate a coordinate."""
    rows = edges.join(features.withColumnRenamed("node", "src"), "src")
    sums = [F.sum(F.get("x", F.lit(i)) * F.col(scale)).alias(f"_h{i}") for i in range(d)]
    return rows.groupBy("dst").agg(*sums).select("dst", F.array(*[F.col(f"_h{i}") for i in range(d)]).alias("h"))


def edge_softmax(scores: DataFrame, keys: tuple[str, ...] = ("dst",)) -> DataFrame:
    """scores(dst, ..., score): alpha, the softmax over a target's incoming edges. Aggregates and joins, no window."""
    top = scores.groupBy(*keys).agg(F.max("score").alias("_top"))
    e = scores.join(top, list(keys)).withColumn("_e", F.exp(F.col("score") - F.col("_top")))
    return e.join(e.groupBy(*keys).agg(F.sum("_e").alias("_sum")), list(keys)).withColumn("alpha", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def gcn_conv(edges: DataFrame, features: DataFrame, w: V.Matrix, *, shortcut: bool = False, relu: bool = False) -> DataFrame:
    """node, x: msg_sum, optionally joined with the node's own features, times W."""
    d = len(w) // 2 if shortcut else len(w)
    h = msg_sum(edges, features, d).withColumnRenamed("dst", "node")
    if shortcut:
        h = h.join(features, "node").select("node", F.concat("h", "x").alias("h"))
    out = V.linear(F.col("h"), w)
    return h.select("node", (F.transform(out, V.relu) if relu else out).alias("x"))


def gcn(edges: DataFrame, features: DataFrame, layers: list[V.Matrix]) -> DataFrame:
    """Layers with ReLU between. Nodes without incoming edges drop out of the next layer's sum as zero."""
    for i, w in enumerate(layers):
        features = gcn_conv(edges, features, w, relu=i < len(layers) - 1)
    return features


def attention_layer(edges: DataFrame, features: DataFrame, wq: V.Matrix, wk: V.Matrix, wv: V.Matrix, wo: V.Matrix, te: int = 2) -> DataFrame:
    """edges(src, dst, eid, dt), features(node, x): node, x after one attention head, output projection, ReLU, norm."""
    q = features.select(F.col("node").alias("dst"), V.linear(F.concat("x", V.time_encode(F.lit(0.0), te)), wq).alias("q"), F.col("x").alias("own"))
    rows = edges.join(features.select(F.col("node").alias("src"), "x"), "src").join(q, "dst")
    kv = F.concat("x", V.time_encode(F.col("dt").cast("double"), te))
    rows = rows.select("dst", "own", "eid", "q", V.linear(kv, wk).alias("k"), V.linear(kv, wv).alias("v"))
    d = len(wq[0])
    # The softmax reads the scores three times, so they are written once.
    scored = cut_lineage(rows.select("dst", "own", "eid", "v", V.leaky_relu(V.dot(F.col("q"), F.col("k")) / (d**0.5)).alias("score")))
    soft = edge_softmax(scored)
    sums = soft.groupBy("dst").agg(F.first("own").alias("own"), *[F.sum(F.get("v", F.lit(i)) * F.col("alpha")).alias(f"_h{i}") for i in range(len(wv[0]))])
    h = F.array(*[F.col(f"_h{i}") for i in range(len(wv[0]))])
    out = F.transform(V.linear(F.concat(h, "own"), wo), V.relu)
    return sums.select(F.col("dst").alias("node"), out.alias("_x")).select("node", V.layer_norm(F.col("_x")).alias("x"))


def graph_attention(edges: DataFrame, features: DataFrame, layers: list[tuple[V.Matrix, V.Matrix, V.Matrix, V.Matrix]]) -> DataFrame:
    """Attention layers with ReLU between. A layer reads its input three times, so each output is written once."""
    for i, (wq, wk, wv, wo) in enumerate(layers):
        features = attention_layer(edges, features, wq, wk, wv, wo)
        if i < len(layers) - 1:
            features = cut_lineage(features.withColumn("x", F.transform("x", V.relu)))
    return features


def input_select(nodes: DataFrame, fresh: DataFrame, fallback: DataFrame) -> DataFrame:
    """Features of nodes from `fresh` where present, else from `fallback`."""
    a, b = fresh.select("node", F.col("x").alias("_a")), fallback.select("node", F.col("x").alias("_b"))
    return nodes.join(a, "node", "left").join(b, "node", "left").select("node", F.coalesce("_a", "_b").alias("x"), F.col("_a").isNull().alias("fell_back"))


def edge_predictor(pairs: DataFrame, h: DataFrame, ws: V.Matrix, wd: V.Matrix, wo: V.Matrix) -> DataFrame:
    """pairs(src, dst, ...): logit = ReLU(h_src Ws + h_dst Wd) Wo; negatives are pairs like any other."""
    rows = pairs.join(h.select(F.col("node").alias("src"), F.col("x").alias("_s")), "src").join(h.select(F.col("node").alias("dst"), F.col("x").alias("_d")), "dst")
    hidden = F.transform(V.add(V.linear(F.col("_s"), ws), V.linear(F.col("_d"), wd)), V.relu)
    return rows.withColumn("logit", F.get(V.linear(hidden, wo), F.lit(0))).drop("_s", "_d")


# Losses and ranking metrics over (batch, score or logit, label).


def mse_loss(rows: DataFrame) -> DataFrame:
    """rows(snap, pred, y): mean of the snapshots' mean squared errors."""
    per = rows.groupBy("snap").agg(F.avg((F.col("pred") - F.col("y")) ** 2).alias("mse"))
    return per.agg(F.avg("mse").alias("mse"))


def bce_logits(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    x, y = F.col("logit"), F.col("label")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return rows.groupBy(*keys).agg(F.avg(loss).alias("bce"))


def average_precision(rows: DataFrame, keys: tuple[str, ...] = ("batch",)) -> DataFrame:
    """Per batch: sum over distinct scores, falling, of precision times the gain of recall. Ties count as one step."""
    per = rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy(F.desc("score"))
    step = per.select(*keys, "p", F.sum("p").over(upto).alias("tp"), F.sum("n").over(upto).alias("seen"), F.sum("p").over(w).alias("all"))
    return step.groupBy(*keys).agg(F.sum(F.try_divide(F.col("tp") * F.col("p"), F.col("seen") * F.col("all"))).alias("ap"))


def roc_auc(rows: DataFrame, keys: tuple[str, ...] = ("batch",)) -> DataFrame:
    """Per batch: the rank-sum form; ties count half. Null where a class is missing."""
    per = rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = per.withColumn("u", F.col("p") * (below + (F.col("n") - F.col("p")) / 2))
    return each.groupBy(*keys).agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum(F.col("n") - F.col("p"))).alias("auc"))
