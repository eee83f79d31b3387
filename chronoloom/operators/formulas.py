"""Heat, intensity, staleness, caching and delta encoding: the documented formulas."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .edges import position_within, running_total


def window_degree(events: DataFrame, width: int) -> DataFrame:
    """events(node, ts): interactions of the node in (ts - width, ts], at each of its times."""
    per = events.groupBy("node", "ts").agg(F.count("*").alias("_c"))
    return per.withColumn("deg", F.sum("_c").over(Window.partitionBy("node").orderBy("ts").rangeBetween(-width + 1, 0))).drop("_c")


#: Length of a stretch of decay, in which sums are scaled without overflow, and stretches behind which nothing is left (e**-700).
STRETCH, REACH = 50.0, 14


def decayed_before(rows: DataFrame, keys: list[str], time: str, weight: str, name: str) -> DataFrame:
    """Adds the sum of weight * exp(-(time - earlier time)) over a key's strictly earlier rows; times are unique in a key.

    Inside a stretch of time by one prefix sum, scaled to its beginning; across stretches by their totals. So a key's
    history spreads over tasks and its rows are never gathered in one.
    """
    rows = rows.withColumn("_b", F.floor(F.col(time) / STRETCH))
    begin = F.col("_b") * STRETCH
    earlier = Window.partitionBy(*keys, "_b").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col(weight) * F.exp(F.col(time) - begin)).over(earlier), F.lit(0.0))
    totals = rows.groupBy(*keys, "_b").agg(F.sum(F.col(weight) * F.exp(F.col(time) - begin - STRETCH)).alias("_r"))
    later = totals.select(*keys, "_b", "_r", F.explode(F.sequence(F.lit(1), F.lit(REACH))).alias("_d"))
    carried = later.groupBy(*keys, (F.col("_b") + F.col("_d")).alias("_b")).agg(F.sum(F.col("_r") * F.exp((1 - F.col("_d")) * STRETCH)).alias("_q"))
    done = rows.withColumn("_in", inside).join(carried, [*keys, "_b"], "left")
    return done.withColumn(name, (F.col("_in") + F.coalesce("_q", F.lit(0.0))) * F.exp(F.col("_b") * STRETCH - F.col(time))).drop("_b", "_in", "_q")


def ema(rows: DataFrame, alpha: float, value: str = "deg", order: str = "step", name: str = "heat") -> DataFrame:
    """h = alpha value + (1 - alpha) h before, from 0, along each node's ordered steps: one row a step."""
    rows = rows.select("node", order, (F.col(value) * alpha).cast("double").alias("_v"))
    if alpha >= 1:
        return rows.withColumnRenamed("_v", name)
    placed = position_within(rows, ["node"], [order], "_i").withColumn("_t", F.col("_i") * -math.log(1 - alpha))
    return decayed_before(placed, ["node"], "_t", "_v", "_s").select("node", order, (F.col("_v") + F.col("_s")).alias(name))


def hawkes_intensity(events: DataFrame, mu: float, alpha: float, omega: float) -> DataFrame:
    """events(pair columns src, dst, ts): mu + sum of alpha exp(-omega (ts - t_k)) over earlier events of the pair.

    Events at the same time do not count for each other.
    """
    per = events.groupBy("src", "dst", "ts").agg((F.count("*") * alpha).alias("_w")).withColumn("_t", F.col("ts") * omega)
    return decayed_before(per, ["src", "dst"], "_t", "_w", "_s").select("src", "dst", "ts", (F.col("_s") + mu).alias("intensity"))


def partition_objective(edges: DataFrame, parts: DataFrame, before: DataFrame, *, beta: float, eta: float) -> DataFrame:
    """Cut edges + beta * squared deviations of the parts' sizes + eta * moved nodes."""
    p = parts.select("node", "part")
    far = edges.join(p.withColumnsRenamed({"node": "src", "part": "a"}), "src").join(p.withColumnsRenamed({"node": "dst", "part": "b"}), "dst")
    cut = far.agg(F.count_if(F.col("a") != F.col("b")).alias("cut"))
    per = p.groupBy("part").count()
    load = per.agg((F.sum(F.col("count") * F.col("count")) - F.sum("count") * F.avg("count")).alias("load"))
    moved = parts.select("node", F.col("cluster" if "cluster" in parts.columns else "part").alias("_c")).join(before, "node").agg(F.count_if(F.col("_c") % 4 != F.col("part")).alias("moved"))
    return cut.crossJoin(load).crossJoin(moved).select((F.col("cut") + F.col("load") * beta + F.col("moved") * eta).alias("objective"))  # one row each


def greedy_assign(edges: DataFrame, parts: DataFrame, penalty: float) -> DataFrame:
    """Each source goes to the part with the largest weight of its targets less penalty times the part's size."""
    near = edges.join(parts.select(F.col("node").alias("dst"), "part"), "dst").groupBy(F.col("src").alias("node"), "part").agg(F.sum("w").alias("near"))
    load = parts.groupBy("part").agg(F.count("*").alias("load"))
    every = edges.select(F.col("src").alias("node")).distinct().crossJoin(F.broadcast(load))  # parts are few
    gain = every.join(near, ["node", "part"], "left").withColumn("g", F.round(F.coalesce("near", F.lit(0.0)) - F.col("load") * penalty, 6))
    return gain.groupBy("node").agg(F.min(F.struct((-F.col("g")).alias("g"), "part")).alias("m")).select("node", F.col("m.part").alias("part"))


def overlap_windows(events: DataFrame, width: int, step: int) -> DataFrame:
    """Copies of each event in the windows [k step - width + 1, k step] that hold it; k is the window."""
    lo, hi = F.ceil(F.col("ts") / step), F.floor((F.col("ts") + width - 1) / step)
    return events.withColumn("k", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))


def staleness_budget(samples: DataFrame, budget: float) -> DataFrame:
    """samples(node, t, weight, age): sum of abs(weight) age for each root, and whether it keeps the budget."""
    return samples.groupBy("node", "t").agg(F.sum(F.abs("weight") * F.col("age")).alias("staleness")).withColumn("within", F.col("staleness") <= budget)


def cache_topk(scores: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest score, ties by id: a limited sort."""
    return scores.orderBy(F.desc("score"), "node").limit(k)


def cache_budget(scores: DataFrame, budget: float) -> DataFrame:
    """scores(node, score, size): nodes by falling score per size, each taken if it still fits the budget; upto is the
    budget used with it.

    Each round takes the nodes up to the first that does not fit and goes on behind it. The budget bounds what is read:
    of the nodes that may still fit, no more than the budget holds of the smallest are ordered.
    """
    rows = cut_lineage(scores.filter("size > 0").withColumn("_d", -F.round(F.col("score") / F.col("size"), 9)))
    taken, used = [], 0
    while True:
        rows = rows.filter(F.col("size") <= budget - used)
        least = rows.agg(F.min("size")).first()[0]
        if least is None:
            break
        top = rows.orderBy("_d", "node").limit(int((budget - used) // least) + 1)
        top = cut_lineage(running_total(top.withColumn("_s", F.col("size")), ["_d", "node"], "_s", "_u").withColumn("upto", F.col("_u") + used))
        fits = top.filter(F.col("upto") <= budget)
        taken.append(fits)
        full = top.filter(F.col("upto") > budget).orderBy("_d", "node").select("_d", "node").first()
        used = fits.agg(F.max("upto")).first()[0] or used
        if full is None:
            break
        rows = rows.filter((F.col("_d") > full["_d"]) | ((F.col("_d") == full["_d"]) & (F.col("node") > full["node"])))
    if not taken:
        return scores.withColumn("upto", F.col("size")).limit(0)
    return functools.reduce(DataFrame.unionByName, taken).select(*scores.columns, "upto")


def delta_encode(states: DataFrame, eps: float, anchor: int) -> DataFrame:
    """states(node, step, h): the change since the step before, whether it is sent, whether the step is an anchor."""
    w = Window.partitionBy("node").orderBy("step")
    before = F.lag("h").over(w)
    i = F.row_number().over(w) - 1
    rows = states.select("node", "step", "h", before.alias("_b"), (i % anchor == 0).alias("anchor"))
    delta = F.zip_with("h", F.coalesce("_b", F.transform("h", lambda x: F.lit(0.0))), lambda a, b: a - b)
    norm = F.array_max(F.transform(delta, F.abs))
    return rows.select("node", "step", "anchor", norm.alias("norm"), (F.col("anchor") | (norm > eps)).alias("sent"), delta.alias("delta"))


def request_dedup_ratio(requests: DataFrame, key: str = "window") -> DataFrame:
    per = requests.groupBy(key).agg(F.count("*").alias("requests"), F.countDistinct("node", "t").alias("unique"))
    return per.withColumn("ratio", 1 - F.col("unique") / F.col("requests"))


def mad_threshold(values: DataFrame, tau: float) -> DataFrame:
    """values(node, v): tau times the median absolute deviation."""
    mid = values.groupBy("node").agg(F.percentile("v", 0.5).alias("_m"))
    return values.join(mid, "node").groupBy("node").agg((F.percentile(F.abs(F.col("v") - F.col("_m")), 0.5) * tau).alias("threshold"))


def hit_rate(requests: DataFrame, cached: DataFrame) -> DataFrame:
    hit = requests.join(cached.select("node").distinct().withColumn("_h", F.lit(1)), "node", "left")
    return hit.agg(F.count("*").alias("requests"), F.count("_h").alias("hits")).withColumn("rate", F.col("hits") / F.col("requests"))


def overlap_rate(pairs: DataFrame) -> DataFrame:
    """pairs(step, compute, fetch): min / max of the two times."""
    return pairs.withColumn("rate", F.try_divide(F.least("compute", "fetch"), F.greatest("compute", "fetch")))


def repartition_trigger(steps: DataFrame, comm: float, load: float, growth: float) -> DataFrame:
    """steps(step, cross_ema, load_ema, grown): whether any threshold is passed."""
    return steps.withColumn("trigger", (F.col("cross_ema") > comm) | (F.col("load_ema") > load) | (F.col("grown") > growth))
