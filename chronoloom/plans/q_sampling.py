"""Neighbour sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import sampling as S
from ..session import pack
from ..sources.adapters import Tables
from .define import EDGES, query

ROOTS = EDGES + ", r AS (SELECT DISTINCT src AS node, ts AS t FROM e)"
#: The range-join form: edges of a root's node before it, ranked from the latest.
BEFORE = ROOTS + """, j AS (SELECT node, t, dst AS nbr, ts, eid, t - ts AS dt,
  row_number() OVER (PARTITION BY node, t ORDER BY ts DESC, eid DESC) AS rank, row_number() OVER (PARTITION BY node, t ORDER BY ts, eid) AS pos,
  count(*) OVER (PARTITION BY node, t) AS cut FROM r JOIN e ON src = node AND ts < t)"""


def tidy(df: DataFrame) -> DataFrame:
    return df.select("node", "t", "nbr", "ts", "eid", "dt", "rank")


@query("sample_recent", BEFORE + " SELECT node, t, nbr, ts, eid, dt, rank FROM j WHERE rank <= 10")
def _(t: Tables):
    return tidy(S.sample_recent(t.purchase_edges(), t.asks(), 10, direction="out"))


@query("edge_rank", EDGES + " SELECT src AS node, dst AS nbr, ts, eid, row_number() OVER (PARTITION BY src ORDER BY ts, eid) AS rn FROM e")
def _(t: Tables):
    return S.History(t.purchase_edges(), "out").rows.withColumn("rn", F.col("rn").cast("long"))


@query("sample_recent_in", EDGES + """, r AS (SELECT DISTINCT dst AS node, ts AS t FROM e), j AS (SELECT node, t, src AS nbr, ts, eid, t - ts AS dt,
  row_number() OVER (PARTITION BY node, t ORDER BY ts DESC, eid DESC) AS rank FROM r JOIN e ON dst = node AND ts <= t) SELECT * FROM j WHERE rank <= 5""")
def _(t: Tables):
    e = t.purchase_edges()
    return tidy(S.sample_recent(e, e.select(F.col("dst").alias("node"), F.col("ts").alias("t")), 5, equal_root_time=True))


@query("sample_cpu_recent", BEFORE + " SELECT node, t, nbr, ts, eid, dt, rank FROM j WHERE rank <= 3")
def _(t: Tables):
    return tidy(S.sample_recent(t.purchase_edges(), t.asks(), 3, direction="out", time_bucket=365))


@query("dedup_overlap", BEFORE + " SELECT node, count(*)::BIGINT AS requests, count(DISTINCT eid)::BIGINT AS edges FROM j WHERE rank <= 10 GROUP BY node")
def _(t: Tables):
    got = S.sample_recent(t.purchase_edges(), t.asks(), 10, direction="out")
    return got.groupBy("node").agg(F.count("*").alias("requests"), F.countDistinct("eid").alias("edges"))


FULL = " SELECT node, t, count(*)::BIGINT AS n, sum(eid)::BIGINT AS eid_sum, min(ts) AS first_ts, max(dt) AS max_dt FROM j GROUP BY node, t"


def summed(df: DataFrame) -> DataFrame:
    return df.groupBy("node", "t").agg(F.count("*").alias("n"), F.sum("eid").alias("eid_sum"), F.min("ts").alias("first_ts"), F.max("dt").alias("max_dt"))


@query("sample_full", BEFORE + FULL)
def _(t: Tables):
    return summed(S.sample_full(t.purchase_edges(), t.asks(), direction="out"))


@query("sample_cluster_c", BEFORE + FULL)
def _(t: Tables):
    return summed(S.sample(t.purchase_edges(), t.asks(), "cluster", direction="out"))


def floyd(k: int) -> str:
    """Draws 1 to k as columns s1 to sk: the number that the hash gives, or the draw's largest where that is taken."""
    out = "SELECT *"
    for j in range(1, k + 1):
        draw = f"1 + ('0x' || substr(md5(node || '|' || t || '|1317|' || {j}), 1, 12))::BIGINT % (cut - {k - j})"
        taken = ", ".join(f"s{i}" for i in range(1, j)) or "0"
        out = f"SELECT *, CASE WHEN {draw} IN ({taken}) THEN cut - {k - j} ELSE {draw} END AS s{j} FROM ({out if j > 1 else 'SELECT * FROM roots'})"
    return out


@query("sample_uniform", BEFORE + f""", roots AS (SELECT DISTINCT node, t, cut FROM j WHERE cut > 5), d AS ({floyd(5)}), k AS (SELECT j.* FROM j LEFT JOIN d USING (node, t) WHERE j.cut <= 5 OR pos IN (s1, s2, s3, s4, s5))
SELECT node, t, nbr, ts, eid, dt, row_number() OVER (PARTITION BY node, t ORDER BY ts, eid) AS rank FROM k""")
def _(t: Tables):
    return tidy(S.sample_uniform(t.purchase_edges(), t.asks(), 5, direction="out"))


def window_sql(start: int, end: int, where: str = "", k: str = "") -> str:
    return ROOTS + f""", j AS (SELECT node, t, dst AS nbr, t AS ts, eid, t - e.ts AS dt, row_number() OVER (PARTITION BY node, t ORDER BY e.ts, eid) AS rank
    FROM r JOIN e ON src = node AND e.ts >= t + {start} AND e.ts < t + {end} {where}) SELECT * FROM j {k}"""


@query("sample_full_d", window_sql(-60, 0))
def _(t: Tables):
    return tidy(S.sample_window(t.purchase_edges(), t.asks(), -60, 0, direction="out"))


@query("sample_uniform_d", window_sql(-200, 0, k="WHERE rank <= 3"))
def _(t: Tables):
    return tidy(S.sample(t.purchase_edges(), t.asks(), "uniform", 3, graph_type="d", start=-200, end=0, direction="out"))


@query("sample_cluster_d", EDGES + """, c AS (SELECT *, eid % 4 AS cluster FROM e), r AS (SELECT DISTINCT src AS node, ts AS t, cluster FROM c)
SELECT node, t, r.cluster, dst AS nbr, t AS ts, eid, t - c.ts AS dt, row_number() OVER (PARTITION BY node, t, r.cluster ORDER BY c.ts, eid) AS rank
FROM r JOIN c ON src = node AND c.cluster = r.cluster AND c.ts >= t - 300 AND c.ts < t""")
def _(t: Tables):
    e = t.purchase_edges().withColumn("cluster", F.col("eid") % 4)
    roots = e.select(F.col("src").alias("node"), F.col("ts").alias("t"), "cluster")
    return S.sample_window(e, roots, -300, 0, direction="out", by=("cluster",)).select("node", "t", "cluster", "nbr", "ts", "eid", "dt", "rank")


@query("sample_window_offset", ROOTS + """, j AS (SELECT node, t, dst AS nbr, ts, eid, t - ts AS dt, row_number() OVER (PARTITION BY node, t ORDER BY ts DESC, eid DESC) AS rank
  FROM r JOIN e ON src = node AND ts <= t AND ts >= t - 100) SELECT * FROM j WHERE rank <= 10""")
def _(t: Tables):
    return tidy(S.sample_recent(t.purchase_edges(), t.asks(), 10, direction="out", window=100, equal_root_time=True))


@query("sample_keep_root_time", BEFORE + " SELECT node, t, nbr, t AS ts, eid, dt, rank FROM j WHERE rank <= 4")
def _(t: Tables):
    return tidy(S.sample_recent(t.purchase_edges(), t.asks(), 4, direction="out", keep_root_time=True))


DISPATCH = {"no such policy": "rank <= 2", 0: "rank <= 2", "recent": "rank <= 2", "full": "rank > 0", 3: "rank > 0", 2: "rank > 0"}


@query("sample_dispatch", BEFORE + " " + " UNION ALL ".join(f"SELECT '{p}' AS policy, node, t, count(*)::BIGINT AS n, sum(eid)::BIGINT AS eid_sum, sum(rank * dt)::BIGINT AS ranked FROM j WHERE {where} GROUP BY node, t" for p, where in DISPATCH.items()))
def _(t: Tables):
    e, out = t.purchase_edges(), None
    for policy, served in S.dispatch(list(DISPATCH)).items():
        got = S.sample(e, t.asks(), policy, 2, direction="out").groupBy("node", "t").agg(F.count("*").alias("n"), F.sum("eid").alias("eid_sum"), F.sum(F.col("rank") * F.col("dt")).alias("ranked"))
        got = pack(got).select(F.explode(F.array(*[F.lit(str(p)) for p in served])).alias("policy"), "node", "t", "n", "eid_sum", "ranked")
        out = got if out is None else out.unionByName(got)
    return out


@query("sample_nearest", ROOTS + """, j AS (SELECT node, t, dst AS nbr, ts, eid, t - ts AS dt, row_number() OVER (PARTITION BY node, t ORDER BY abs(ts - t), ts, eid) AS rank
  FROM r JOIN e ON src = node) SELECT * FROM j WHERE rank <= 3""")
def _(t: Tables):
    return tidy(S.sample_nearest(t.purchase_edges(), t.asks(), 3, direction="out"))


@query("sample_bloom_distinct", ROOTS + """, j AS (SELECT node, t, dst AS nbr, ts, eid, row_number() OVER (PARTITION BY node, t, dst ORDER BY ts DESC, eid DESC) AS d FROM r JOIN e ON src = node AND ts <= t),
k AS (SELECT node, t, nbr, ts, eid, t - ts AS dt, row_number() OVER (PARTITION BY node, t ORDER BY ts DESC, eid DESC) AS rank FROM j WHERE d = 1) SELECT * FROM k WHERE rank <= 5""")
def _(t: Tables):
    return tidy(S.sample_distinct(t.purchase_edges(), t.asks(), 5, direction="out"))


UNDIRECTED = EDGES + """, u AS (SELECT eid, src, dst, ts FROM e UNION ALL SELECT eid, dst, src, ts FROM e), r AS (SELECT DISTINCT src AS node, ts AS t FROM e),
h0 AS (SELECT * FROM (SELECT node, t, src AS nbr, ts, eid, t - ts AS dt, row_number() OVER (PARTITION BY node, t ORDER BY ts DESC, eid DESC) AS rank FROM r JOIN u ON dst = node AND ts < t) WHERE rank <= 5),
r1 AS (SELECT DISTINCT nbr AS node, ts AS t FROM h0),
h1 AS (SELECT * FROM (SELECT node, t, src AS nbr, ts, eid, t - ts AS dt, row_number() OVER (PARTITION BY node, t ORDER BY ts DESC, eid DESC) AS rank FROM r1 JOIN u ON dst = node AND ts < t) WHERE rank <= 5)"""


@query("khop_recent_2", UNDIRECTED + " SELECT 0 AS layer, * FROM h0 UNION ALL SELECT 1, * FROM h1")
def _(t: Tables):
    e = t.purchase_edges().select("eid", "src", "dst", "ts")
    return S.khop_sample(E.reverse_edges(e), t.asks(), [5, 5]).select("layer", "node", "t", "nbr", "ts", "eid", "dt", "rank")


@query("khop_sample", UNDIRECTED + " SELECT 0 AS layer, count(*)::BIGINT AS n, sum(eid)::BIGINT AS eid_sum, sum(dt)::BIGINT AS dt_sum FROM h0 UNION ALL SELECT 1, count(*)::BIGINT, sum(eid)::BIGINT, sum(dt)::BIGINT FROM h1")
def _(t: Tables):
    e = t.purchase_edges().select("eid", "src", "dst", "ts")
    got = S.khop_sample(E.reverse_edges(e), t.asks(), [5, 5])
    return got.groupBy("layer").agg(F.count("*").alias("n"), F.sum("eid").alias("eid_sum"), F.sum("dt").alias("dt_sum"))


@query("khop_offsets_relative", UNDIRECTED + " SELECT h1.node, h1.t, count(*)::BIGINT AS n, max(h1.ts) AS last_ts, count(*) FILTER (h1.ts >= h1.t)::BIGINT AS violations FROM h1 GROUP BY 1, 2")
def _(t: Tables):
    e = t.purchase_edges().select("eid", "src", "dst", "ts")
    second = S.khop_sample(E.reverse_edges(e), t.asks(), [5, 5]).filter("layer = 1")
    return second.groupBy("node", "t").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.count_if(F.col("ts") >= F.col("t")).alias("violations"))


@query("chunk_seeds", EDGES + " SELECT src AS node, ts, list_sort(list(eid))::VARCHAR AS eids FROM e WHERE src % 8 IN (2, 5) AND ts >= 200 AND ts < 1200 GROUP BY 1, 2")
def _(t: Tables):
    e = t.purchase_edges()
    chunks = E.nodes(e).select("node", (F.col("node") % 8).alias("chunk"))
    return S.chunk_seeds(e, chunks, [2, 5], 200, 1200).withColumn("eids", F.col("eids").cast("string"))
