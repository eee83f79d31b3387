"""Batch construction, and the formulas over event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators import edges as E
from ..operators import formulas as X
from ..operators import sampling as S
from ..sources.adapters import Tables
from .define import EDGES, EVENTS, NODES, query
from .q_partition import FEATS
from .q_sampling import BEFORE


@query("task_link", EDGES + " SELECT side, eid, node, t, label, row_number() OVER (ORDER BY side, eid) - 1 AS ord FROM (SELECT 0 AS side, eid, src AS node, ts AS t, label FROM e UNION ALL SELECT 1, eid, dst, ts, label FROM e)")
def _(t: Tables):
    return B.task_link(t.purchase_edges())


@query("task_node", EDGES + " SELECT src AS node, min(ts) AS t FROM e GROUP BY src")
def _(t: Tables):
    return B.task_node(t.purchase_edges())


@query("task_neg", NODES + """, x AS (SELECT eid, ts AS t, dst, dst % 4 AS part FROM e), pool AS (SELECT part, dst, row_number() OVER (PARTITION BY part ORDER BY dst) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM (SELECT DISTINCT part, dst FROM x))
SELECT x.part, s::INT AS neg_set, eid, 0 AS k, pool.dst AS node, t FROM x, (SELECT unnest(range(2)) AS s) JOIN pool ON pool.part = x.part AND pool.idx = (eid * 2654435761 + s * 40503) % n""")
def _(t: Tables):
    return B.negatives(t.purchase_edges().withColumn("part", F.col("dst") % 4), num_set=2, part="part")


@query("neg_sampler_set", EDGES + ", pool AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT dst FROM e)) SELECT eid, pool.dst AS node, ts AS t FROM e JOIN pool ON idx = (eid * 2654435761 + 7) % n")
def _(t: Tables):
    return B.negatives(t.purchase_edges(), seed=7).select("eid", "node", "t")


@query("neg_sampler_uniform", EDGES + " SELECT eid, (eid * 2654435761 + 11) % 5000 AS node, ts AS t FROM e")
def _(t: Tables):
    return B.negatives_uniform(t.purchase_edges(), 5000, seed=11)


@query("build_csc", EDGES + " SELECT dst AS dst_local, count(*)::BIGINT AS n, list(src ORDER BY ts, eid)::VARCHAR AS indices, list(eid ORDER BY ts, eid)::VARCHAR AS eid FROM e GROUP BY dst")
def _(t: Tables):
    rows = t.purchase_edges().select(F.col("dst").alias("dst_local"), "ts", F.lit(0).cast("long").alias("dt"), "eid", F.col("src").alias("src_local"))
    return B.build_csc(rows).select("dst_local", "n", F.col("indices").cast("string").alias("indices"), F.col("eid").cast("string").alias("eid"))


@query("merge_and_map", EDGES + ", u AS (SELECT src AS id, ts FROM e UNION SELECT dst, ts FROM e) SELECT id, ts, row_number() OVER (ORDER BY id, ts) - 1 AS local_id FROM u")
def _(t: Tables):
    e = t.purchase_edges()
    return B.merge_and_map(e.select(F.col("src").alias("id"), "ts"), e.select(F.col("dst").alias("id"), "ts"))[0]


@query("remap_ids", EDGES + ", a AS (SELECT gid, row_number() OVER (ORDER BY gid) - 1 AS local_id FROM (SELECT DISTINCT src AS gid FROM e WHERE ts < 1800)), b AS (SELECT gid, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY gid) - 1 AS local_id FROM (SELECT DISTINCT dst AS gid FROM e UNION SELECT src FROM e) WHERE gid NOT IN (SELECT gid FROM a)) SELECT * FROM a UNION ALL SELECT * FROM b")
def _(t: Tables):
    e = t.purchase_edges()
    first = B.remap_ids(None, e.filter("ts < 1800").select(F.col("src").alias("gid")))
    return B.remap_ids(first, E.nodes(e).withColumnRenamed("node", "gid"))


BLOCK = BEFORE + """, r2 AS (SELECT node, t, row_number() OVER (ORDER BY node, t) - 1 AS root_id FROM r),
b AS (SELECT root_id, nbr, ts, eid, dt, row_number() OVER (ORDER BY root_id, ts, eid) - 1 + (SELECT count(*) FROM r) AS src_local FROM j JOIN r2 USING (node, t) WHERE rank <= 3)"""


def block(t: Tables):
    e, roots = t.purchase_edges(), t.roots()
    return B.to_block(roots, S.sample_recent(e, roots, 3, direction="out"))


@query("to_block", BLOCK + " SELECT src_local, root_id AS dst_local, eid, dt FROM b")
def _(t: Tables):
    return block(t)[1]


@query("to_block_nodes", BLOCK + " SELECT root_id AS local_id, node, t AS ts FROM r2 UNION ALL SELECT src_local, nbr, ts FROM b")
def _(t: Tables):
    return block(t)[0]


@query("rebuild_events", EDGES + " SELECT eid, src, dst, ts FROM e")
def _(t: Tables):
    e = t.purchase_edges().select("eid", "src", "dst", "ts")
    return B.rebuild_events(B.nested_roots(E.interleave_reverse(e)))


@query("async_snapshots", EDGES + " SELECT 0 AS query_id, 'r' AS tag, src AS node, ts, count(*)::BIGINT AS n FROM e WHERE src % 8 = 1 AND ts >= 1200 AND ts < 1900 GROUP BY src, ts UNION ALL SELECT 1, 'f', src, ts, count(*) FROM e WHERE src % 8 IN (2, 3) AND ts >= 1500 AND ts < 2500 GROUP BY src, ts")
def _(t: Tables):
    e = t.purchase_edges()
    chunks = E.nodes(e).select("node", (F.col("node") % 8).alias("chunk"))
    return B.async_snapshots(e, chunks, [(1200, 1900, [1]), (1500, 2500, [2, 3])]).select("query_id", "tag", "node", "ts", F.size("eids").cast("long").alias("n"))


NEGATIVES = """, x AS (SELECT eid, ts AS t, dst, dst % 4 AS part, ts // 10 AS slot FROM e), pool AS (SELECT part, dst, row_number() OVER (PARTITION BY part ORDER BY dst) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM (SELECT DISTINCT part, dst FROM x))"""


@query("slot_batches", NODES + NEGATIVES + """, so AS (SELECT slot, (row_number() OVER (ORDER BY slot) - 1) // 4 AS step FROM (SELECT DISTINCT slot FROM x)),
g AS (SELECT part, slot, eid, src AS node, t, 'pos' AS kind FROM x JOIN e USING (eid) UNION ALL
  SELECT x.part, slot, eid, pool.dst, t, 'neg' FROM x JOIN pool ON pool.part = x.part AND pool.idx = (eid * 2654435761 + 2 * 40503) % n)
SELECT step, part, slot, kind, eid, node, t FROM g JOIN so USING (slot)""")
def _(t: Tables):
    e = t.purchase_edges().withColumns({"part": F.col("dst") % 4, "slot": F.expr("ts div 10")})
    negative = B.negatives(e, num_set=3, part="part").join(e.select("eid", "slot"), "eid").select("part", "slot", "neg_set", "eid", "node", "t")
    positive = e.select("part", "slot", "eid", F.col("src").alias("node"), F.col("ts").alias("t"))
    return B.slot_batches(positive, negative, 4, epoch=5).select("step", "part", "slot", "kind", "eid", "node", "t")


INPUTS = BLOCK + """, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)""" + FEATS + """, bn AS (SELECT node % 4 AS part, root_id AS local_id, node, t AS ts FROM r2 UNION ALL SELECT r2.node % 4, src_local, nbr, ts FROM b JOIN r2 USING (root_id)),
ml AS (SELECT * FROM (SELECT node, ts, w, row_number() OVER (PARTITION BY node ORDER BY ts DESC, eid DESC, side DESC) AS k FROM (SELECT eid, ts, w, 0 AS side, src AS node FROM e UNION ALL SELECT eid, ts, w, 1, dst FROM e)) WHERE k = 1),
hi AS (SELECT src AS node, ts // 100 * 100 AS ts, sum(w) AS h FROM e GROUP BY 1, 2)"""


@query("batch_inputs", INPUTS + """ SELECT bn.part, bn.local_id, bn.node, bn.node % 4 <> bn.part AS is_remote, ft.x0 AS x, ft.x1 AS mem, bn.node % 100 AS mem_ts, ml.w AS mail, ml.ts AS mail_ts, hi.h AS hist, hi.ts AS hist_ts
FROM bn JOIN ft USING (node) JOIN ml ON ml.node = bn.node ASOF LEFT JOIN hi ON hi.node = bn.node AND hi.ts <= bn.ts""")
def _(t: Tables):
    from ..operators import state as T
    from .q_partition import node_features

    e = t.purchase_edges()
    every = E.nodes(e)
    sources, links = block(t)
    owner = every.select("node", F.pmod("node", F.lit(4)).alias("part"))
    roots = t.roots().count()
    first = sources.filter(F.col("local_id") < roots).join(owner, "node").select("part", "local_id", "node", "ts")
    rest = sources.filter(F.col("local_id") >= roots).join(links.select(F.col("src_local").alias("local_id"), F.col("dst_local").alias("_r")), "local_id").join(first.select(F.col("local_id").alias("_r"), "part"), "_r")
    x = node_features(t, every, 2)
    memory = x.select("node", F.get("x", F.lit(1)).alias("h"), (F.col("node") % 100).alias("ts"))
    events = e.select(F.lit(0).alias("batch"), "eid", "src", "dst", "ts", F.array("w").alias("feat"))
    mail = T.mail_messages(events, x.select("node", F.col("x").alias("h"))).select("node", "ts", F.get("mail", F.lit(4)).alias("mail"))
    history = e.groupBy(F.col("src").alias("node"), F.expr("ts div 100 * 100").alias("ts")).agg(F.sum("w").alias("h"))
    got = B.batch_inputs(first.unionByName(rest.select("part", "local_id", "node", "ts")), owner, x.select("node", F.get("x", F.lit(0)).alias("x")), memory, mail, history)
    return got.select("part", "local_id", "node", "is_remote", "x", "mem", "mem_ts", "mail", "mail_ts", "hist", "hist_ts")


@query("edge_inputs", BLOCK + " SELECT src_local, root_id AS dst_local, eid, dt, w AS f FROM b JOIN e USING (eid)")
def _(t: Tables):
    return B.edge_inputs(block(t)[1], t.purchase_edges().select("eid", F.col("w").alias("f"))).select("src_local", "dst_local", "eid", "dt", "f")


# Formulas.


@query("window_degree", EDGES + ", x AS (SELECT DISTINCT src AS node, ts FROM e) SELECT x.node, x.ts, count(*)::BIGINT AS deg FROM x JOIN e ON src = node AND e.ts > x.ts - 90 AND e.ts <= x.ts GROUP BY 1, 2")
def _(t: Tables):
    return X.window_degree(t.purchase_edges().select(F.col("src").alias("node"), "ts"), 90)


STEPS = EDGES + ", s AS (SELECT src AS node, ts // 100 AS step, count(*)::BIGINT AS deg FROM e GROUP BY 1, 2)"


def steps(t: Tables):
    return t.purchase_edges().groupBy(F.col("src").alias("node"), F.expr("ts div 100").alias("step")).agg(F.count("*").alias("deg"))


@query("ema_heat", STEPS + ", o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY step) AS i FROM s) SELECT a.node, a.step, round(sum(0.25::DOUBLE * b.deg * pow(0.75::DOUBLE, a.i - b.i)), 6) AS heat FROM o a JOIN o b ON a.node = b.node AND b.i <= a.i GROUP BY 1, 2")
def _(t: Tables):
    return X.ema(steps(t), 0.25).withColumn("heat", F.round(F.round("heat", 12), 6))  # halves are exact in SQL


@query("hawkes_intensity", EVENTS + ", h AS (SELECT src, dst, ts // 3600000000 AS ts FROM e), x AS (SELECT DISTINCT src, dst, ts FROM h) SELECT x.src, x.dst::BIGINT AS dst, x.ts, round(0.1 + coalesce(sum(0.5::DOUBLE * exp(-0.05::DOUBLE * (x.ts - h.ts))), 0), 6) AS intensity FROM x LEFT JOIN h ON h.src = x.src AND h.dst = x.dst AND h.ts < x.ts GROUP BY 1, 2, 3")
def _(t: Tables):
    hours = t.event_edges().select("src", "dst", F.expr("ts div 3600000000").alias("ts"))
    return X.hawkes_intensity(hours, 0.1, 0.5, 0.05).withColumn("intensity", F.round("intensity", 6))


@query("overlap_windows", EVENTS + ", h AS (SELECT eid, ts // 3600000000 AS ts FROM e) SELECT eid, k FROM h, LATERAL (SELECT unnest(range((ts + 11) // 12, (ts + 24 - 1) // 12 + 1)) AS k)")
def _(t: Tables):
    hours = t.event_edges().select("eid", F.expr("ts div 3600000000").alias("ts"))
    return X.overlap_windows(hours, 24, 12).select("eid", "k")


@query("sliding_windows", EVENTS + ", h AS (SELECT eid, w, ts // 3600000000 AS ts FROM e) SELECT k, count(*)::BIGINT AS n, round(sum(w), 4) AS w FROM h, LATERAL (SELECT unnest(range((ts + 11) // 12, (ts + 24 - 1) // 12 + 1)) AS k) GROUP BY k")
def _(t: Tables):
    hours = t.event_edges().select("eid", "w", F.expr("ts div 3600000000").alias("ts"))
    return X.overlap_windows(hours, 24, 12).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"))


@query("staleness_budget", BEFORE + ", s AS (SELECT node, t, sum(abs((eid % 7 - 3) / 10.0::DOUBLE) * dt) AS staleness FROM j WHERE rank <= 5 GROUP BY 1, 2) SELECT node, t, round(staleness, 6) AS staleness, round(staleness, 6) <= 40 AS within FROM s")
def _(t: Tables):
    got = S.sample_recent(t.purchase_edges(), t.roots(), 5, direction="out")
    s = got.select("node", "t", ((F.col("eid") % 7 - 3) / 10).alias("weight"), F.col("dt").alias("age"))
    done = X.staleness_budget(s, 40).withColumn("staleness", F.round("staleness", 6))
    return done.withColumn("within", F.col("staleness") <= 40)


SCORES = EDGES + ", sc AS (SELECT src AS node, count(*) * (1 + src % 3) AS score, 1 + src % 5 AS size FROM e GROUP BY src)"


def scores(t: Tables):
    per = t.purchase_edges().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("c"))
    return per.select("node", (F.col("c") * (1 + F.col("node") % 3)).alias("score"), (1 + F.col("node") % 5).alias("size"))


@query("cache_score", SCORES + " SELECT node, score, size FROM sc")
def _(t: Tables):
    return scores(t)


@query("cache_topk", SCORES + " SELECT node, score, size FROM sc ORDER BY score DESC, node LIMIT 100")
def _(t: Tables):
    return X.cache_topk(scores(t), 100)


#: Greedy by recursion along the order: a node that does not fit is passed over.
KNAPSACK = SCORES + """, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(score / size::DOUBLE, 9) DESC, node) AS i FROM sc), kn AS (
  WITH RECURSIVE g AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, FALSE AS took UNION ALL
    SELECT o.i, CASE WHEN used + size <= 300 THEN used + size ELSE used END, used + size <= 300 FROM g JOIN o ON o.i = g.i + 1) SELECT * FROM g)"""


@query("cache_knapsack", KNAPSACK + " SELECT node, score, size, used AS upto FROM kn JOIN o USING (i) WHERE took")
def _(t: Tables):
    return X.cache_budget(scores(t), 300)


@query("delta_encode", STEPS + ", o AS (SELECT node, step, deg, lag(deg) OVER (PARTITION BY node ORDER BY step) AS b, row_number() OVER (PARTITION BY node ORDER BY step) - 1 AS i FROM s) SELECT node, step, i % 4 = 0 AS anchor, abs(deg - coalesce(b, 0))::DOUBLE AS norm, i % 4 = 0 OR abs(deg - coalesce(b, 0)) > 1 AS sent FROM o")
def _(t: Tables):
    s = steps(t).withColumn("h", F.array(F.col("deg").cast("double"), (F.col("deg") / 2).cast("double")))
    return X.delta_encode(s, 1.0, 4).select("node", "step", "anchor", "norm", "sent")


@query("request_dedup_ratio", BEFORE + " SELECT t // 100 AS window, count(*)::BIGINT AS requests, count(DISTINCT (nbr, ts))::BIGINT AS unique, 1 - count(DISTINCT (nbr, ts)) / count(*) AS ratio FROM j WHERE rank <= 5 GROUP BY 1")
def _(t: Tables):
    got = S.sample_recent(t.purchase_edges(), t.roots(), 5, direction="out")
    return X.request_dedup_ratio(got.select(F.expr("t div 100").alias("window"), F.col("nbr").alias("node"), F.col("ts").alias("t")))


@query("mad_threshold", STEPS + ", m AS (SELECT node, median(deg) AS m FROM s GROUP BY node) SELECT node, 1.5::DOUBLE * median(abs(deg - m)) AS threshold FROM s JOIN m USING (node) GROUP BY node")
def _(t: Tables):
    return X.mad_threshold(steps(t).select("node", F.col("deg").alias("v")), 1.5)


@query("hit_rate", SCORES + ", k AS (SELECT node FROM sc ORDER BY score DESC, node LIMIT 100) SELECT count(*)::BIGINT AS requests, count(*) FILTER (src IN (SELECT node FROM k))::BIGINT AS hits, count(*) FILTER (src IN (SELECT node FROM k)) / count(*) AS rate FROM e")
def _(t: Tables):
    return X.hit_rate(t.purchase_edges().select(F.col("src").alias("node")), X.cache_topk(scores(t), 100))


@query("overlap_rate", EDGES + ", s AS (SELECT ts // 100 AS step, sum(w) AS compute, 50.0::DOUBLE * count(DISTINCT src) AS loading FROM e GROUP BY 1) SELECT step, compute, loading AS \"fetch\", least(compute, loading) / greatest(compute, loading) AS rate FROM s")
def _(t: Tables):
    per = t.purchase_edges().groupBy(F.expr("ts div 100").alias("step")).agg(F.sum("w").alias("compute"), (F.countDistinct("src") * 50.0).alias("fetch"))
    return X.overlap_rate(per)


@query("repartition_trigger", EDGES + ", s AS (SELECT ts // 100 AS step, count(*) FILTER (src % 4 <> dst % 4) / count(*) AS cross_ema, count(*)::DOUBLE AS load_ema, 0.0::DOUBLE AS grown FROM e GROUP BY 1) SELECT step, cross_ema > 0.76 OR load_ema > 2500 AS trigger FROM s")
def _(t: Tables):
    per = t.purchase_edges().groupBy(F.expr("ts div 100").alias("step")).agg((F.count_if(F.col("src") % 4 != F.col("dst") % 4) / F.count("*")).alias("cross_ema"), F.count("*").cast("double").alias("load_ema"), F.lit(0.0).alias("grown"))
    return X.repartition_trigger(per, 0.76, 2500, 1.0).select("step", "trigger")
