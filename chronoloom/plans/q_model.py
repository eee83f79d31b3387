"""Scalar and vector functions, messages, layers, state, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import edges as E
from ..operators import messages as M
from ..operators import state as T
from ..sources.adapters import Tables
from .define import EDGES, NODES, query
from .q_partition import FEATS, node_features
from .q_stats import FEAT, SNAP


def total(parts) -> str:
    return " + ".join(parts)


def lin(xs: list[str], w: V.Matrix, j: int) -> str:
    return "(" + total(f"({x}) * ({w[i][j]})::DOUBLE" for i, x in enumerate(xs)) + ")"


def rounded(df, column: str, d: int, name: str = "h", digits: int = 5):
    return df.select(*[c for c in df.columns if c != column], *[F.round(F.get(column, F.lit(i)), digits).alias(f"{name}{i}") for i in range(d)])


X4 = [f"x{i}" for i in range(4)]


@query("edge_dt", EDGES + " SELECT eid, 4000 - ts AS dt FROM e")
def _(t: Tables):
    return t.purchase_edges().select("eid", (F.lit(4000) - F.col("ts")).alias("dt"))


@query("time_encode", EDGES + " SELECT eid, " + ", ".join(f"round(cos(ts * pow(10.0::DOUBLE, -9 * {i} / 3.0::DOUBLE)), 6) AS e{i}" for i in range(4)) + " FROM e")
def _(t: Tables):
    return rounded(t.purchase_edges().select("eid", V.time_encode(F.col("ts").cast("double"), 4).alias("v")), "v", 4, "e", 6)


@query("activations", "SELECT event_id, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(tanh(v), 6) AS tanh, greatest(v, 0) AS relu, round(v / (1 + exp(-v)), 6) AS silu, round(CASE WHEN v >= 0 THEN v ELSE v * 0.2 END, 6) AS leaky FROM (SELECT event_id, value / 50 - 1 AS v FROM events)")
def _(t: Tables):
    v = t.table("events").select("event_id", (F.col("value") / 50 - 1).alias("v"))
    x = F.col("v")
    return v.select("event_id", F.round(V.sigmoid(x), 6).alias("sigmoid"), F.round(F.tanh(x), 6).alias("tanh"), V.relu(x).alias("relu"), F.round(V.silu(x), 6).alias("silu"), F.round(V.leaky_relu(x), 6).alias("leaky"))


EMB = "SELECT vec_id, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS x3 FROM embeddings"


def emb(t: Tables):
    return t.table("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda a: a.cast("double")).alias("x"))


#: All 64 numbers of each vector.
ALL = "SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings"


def every(t: Tables):
    return t.table("embeddings").select("vec_id", F.transform("embedding", lambda a: a.cast("double")).alias("x"))


def digest(column):
    """Of a vector, rounded to five digits."""
    return F.md5(F.transform(column, lambda v: F.round(v * 1e5).cast("long")).cast("string")).alias("h_md5")


DIGEST = "md5(list_transform({}, lambda v: round(v * 1e5)::BIGINT)::VARCHAR) AS h_md5"


@query("softmax", f"WITH m AS ({ALL}), s AS (SELECT *, list_transform(x, lambda v: exp(v)) AS p FROM m) SELECT vec_id, {DIGEST.format('list_transform(p, lambda v: v / list_sum(p))')} FROM s")
def _(t: Tables):
    return every(t).select("vec_id", digest(V.softmax(F.col("x"))))


@query("linear", f"WITH m AS ({ALL}) SELECT vec_id, " + ", ".join(f"round(list_dot_product(x, {[row[j] for row in V.weights(64, 3)]}::DOUBLE[]), 5) AS h{j}" for j in range(3)) + " FROM m")
def _(t: Tables):
    return rounded(every(t).select("vec_id", V.linear(F.col("x"), V.weights(64, 3)).alias("h")), "h", 3, digits=5)


@query("dot", f"WITH m AS ({ALL}) SELECT vec_id, round(list_dot_product(x, x), 6) AS dot FROM m")
def _(t: Tables):
    return every(t).select("vec_id", F.round(V.dot(F.col("x"), F.col("x")), 6).alias("dot"))


@query("layer_norm", f"WITH m AS ({ALL}), a AS (SELECT *, list_avg(x) AS mu FROM m), b AS (SELECT *, list_avg(list_transform(x, lambda v: (v - mu) ** 2)) AS va FROM a) SELECT vec_id, {DIGEST.format('list_transform(x, lambda v: (v - mu) / sqrt(va + 1e-5))')} FROM b")
def _(t: Tables):
    return every(t).select("vec_id", digest(V.layer_norm(F.col("x"))))


@query("concat_vec", f"WITH m AS ({ALL}) SELECT vec_id, {DIGEST.format('x || x[1:2]')} FROM m")
def _(t: Tables):
    return every(t).select("vec_id", digest(F.concat("x", F.slice("x", 1, 2))))


@query("log1p_label", EDGES + " SELECT dst AS node, round(ln(count(*) + 1), 9) AS label FROM e GROUP BY dst")
def _(t: Tables):
    return t.purchase_edges().groupBy(F.col("dst").alias("node")).agg(F.round(F.log1p(F.count("*")), 9).alias("label"))


@query("nan_to_num", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END AS r FROM lineitem")
def _(t: Tables):
    l = t.table("lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_tax", "l_discount"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", V.nan_to_num(ratio).alias("r"))


@query("clamp_min", EDGES + " SELECT eid, greatest(ts - 2000, 0) AS v FROM e")
def _(t: Tables):
    return t.purchase_edges().select("eid", F.greatest(F.col("ts") - 2000, F.lit(0).cast("long")).alias("v"))


@query("bit_ops", EDGES + " SELECT eid, eid << 3 AS up, eid >> 2 AS down, eid & 255 AS low, eid | 1 AS odd, xor(eid, 5) AS flip FROM e")
def _(t: Tables):
    i = F.col("eid")
    return t.purchase_edges().select("eid", F.shiftleft(i, 3).alias("up"), F.shiftright(i, 2).alias("down"), i.bitwiseAND(255).alias("low"), i.bitwiseOR(1).alias("odd"), i.bitwiseXOR(F.lit(5)).alias("flip"))


@query("repeat_interleave", EDGES + " SELECT eid, unnest(range(eid % 4)) AS k FROM e")
def _(t: Tables):
    n = F.col("eid") % 4
    return t.purchase_edges().select("eid", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))).alias("k"))


@query("arange_segments", EDGES + " SELECT src, eid, row_number() OVER (PARTITION BY src ORDER BY eid) - 1 AS off FROM e")
def _(t: Tables):
    lists = t.purchase_edges().groupBy("src").agg(F.sort_array(F.collect_list("eid")).alias("l"))
    return lists.select("src", F.posexplode("l").alias("off", "eid")).select("src", "eid", F.col("off").cast("long").alias("off"))


@query("filename_parse", EDGES + ", f AS (SELECT DISTINCT 'slot_' || lpad((ts // 100)::VARCHAR, 4, '0') || '_sub_' || lpad((src % 16)::VARCHAR, 4, '0') || '.pt' AS name FROM e) SELECT name, regexp_extract(name, 'slot_([0-9]+)_sub_([0-9]+)', 1)::INT AS slot, regexp_extract(name, 'slot_([0-9]+)_sub_([0-9]+)', 2)::INT AS sub FROM f")
def _(t: Tables):
    from ..sources.readers import parse_chunk_name

    name = F.format_string("slot_%04d_sub_%04d.pt", F.expr("ts div 100"), F.col("src") % 16).alias("name")
    slot, sub = parse_chunk_name(F.col("name"))
    return t.purchase_edges().select(name).distinct().select("name", slot.alias("slot"), sub.alias("sub"))


# Messages and layers.

GRAPH = NODES + FEATS + """, i AS (SELECT dst, sum(w) AS iw, count(*) AS ic FROM e GROUP BY dst), o AS (SELECT src, sum(w) AS ow, count(*) AS oc FROM e GROUP BY src),
g AS (SELECT e.*, w / sqrt(iw * ow) AS norm, 1 / sqrt(ic * oc) AS dnorm, w / iw AS bnorm FROM e JOIN i USING (dst) JOIN o USING (src))"""
SUMS = GRAPH + ", m AS (SELECT dst AS node, " + ", ".join(f"sum(x{i} * norm) AS h{i}" for i in range(4)) + " FROM g JOIN ft ON ft.node = src GROUP BY dst)"


def graph(t: Tables, kind: str = "graph"):
    e = t.purchase_edges()
    return M.gcn_norm(e, kind), node_features(t, E.nodes(e))


@query("gcn_norm", GRAPH + " SELECT eid, round(norm, 9) AS norm, round(dnorm, 9) AS dnorm, round(bnorm, 9) AS bnorm FROM g")
def _(t: Tables):
    e = t.purchase_edges()
    one = lambda kind, name: M.gcn_norm(e, kind).select("eid", F.round("norm", 9).alias(name))
    return one("graph", "norm").join(one("degree", "dnorm"), "eid").join(one("block", "bnorm"), "eid")


@query("msg_sum", SUMS + " SELECT node, " + ", ".join(f"round(h{i}, 6) AS h{i}" for i in range(4)) + " FROM m")
def _(t: Tables):
    return rounded(M.msg_sum(*graph(t), 4).withColumnRenamed("dst", "node"), "h", 4, digits=6)


SOFT = EDGES + ", s AS (SELECT eid, dst, (ts % 17) / 10.0::DOUBLE AS score FROM e), z AS (SELECT *, exp(score - max(score) OVER (PARTITION BY dst)) AS x FROM s), al AS (SELECT eid, dst, x / sum(x) OVER (PARTITION BY dst) AS alpha FROM z)"


def soft(t: Tables):
    return M.edge_softmax(t.purchase_edges().select("eid", "src", "dst", "w", ((F.col("ts") % 17) / 10).alias("score")))


@query("edge_softmax", SOFT + " SELECT eid, dst, round(alpha, 9) AS alpha FROM al")
def _(t: Tables):
    return soft(t).select("eid", "dst", F.round("alpha", 9).alias("alpha"))


@query("attn_sum", SOFT + " SELECT e.dst, round(sum(alpha * w), 6) AS h FROM al JOIN e USING (eid) GROUP BY e.dst")
def _(t: Tables):
    return soft(t).groupBy("dst").agg(F.round(F.sum(F.col("alpha") * F.col("w")), 6).alias("h"))


W1, W2 = V.weights(4, 3), V.weights(3, 2, 4)
H4 = [f"h{i}" for i in range(4)]


@query("gcn_conv", SUMS + " SELECT node, " + ", ".join(f"round({lin(H4, W1, j)}, 5) AS h{j}" for j in range(3)) + " FROM m")
def _(t: Tables):
    return rounded(M.gcn_conv(*graph(t), W1), "x", 3)


@query("gcn", SUMS + ", rv AS (SELECT eid, src AS dst, dst AS src, norm FROM g UNION ALL SELECT eid, dst, src, norm FROM g), m1 AS (SELECT rv.dst AS node, " + ", ".join(f"sum(x{i} * norm) AS q{i}" for i in range(4)) + " FROM rv JOIN ft ON ft.node = rv.src GROUP BY 1), l1 AS (SELECT node, " + ", ".join(f"greatest({lin([f'q{i}' for i in range(4)], W1, j)}, 0) AS y{j}" for j in range(3)) + " FROM m1), m2 AS (SELECT rv.dst AS node, " + ", ".join(f"sum(y{i} * norm) AS z{i}" for i in range(3)) + " FROM rv JOIN l1 ON l1.node = rv.src GROUP BY 1) SELECT node, " + ", ".join(f"round({lin(['z0', 'z1', 'z2'], W2, j)}, 5) AS h{j}" for j in range(2)) + " FROM m2")
def _(t: Tables):
    e, x = graph(t)
    both = E.reverse_edges(e.select("eid", "src", "dst", "norm"))
    return rounded(M.gcn(both, x, [W1, W2]), "x", 2)


def features2(t: Tables, e):
    return node_features(t, E.nodes(e), 2)


WQ, WK, WV, WO = V.weights(4, 2, 1), V.weights(4, 2, 2), V.weights(4, 2, 3), V.weights(4, 2, 5)
TE = ["cos(DT::DOUBLE * 1.0)", "cos(DT::DOUBLE * 1e-9::DOUBLE)"]
QIN, KIN = ["d.x0", "d.x1", "1.0::DOUBLE", "1.0::DOUBLE"], ["s.x0", "s.x1", *[x.replace("DT", "(4000 - ts)") for x in TE]]


def attention(edges: str, feats: str, p: str) -> str:
    """CTEs of one layer over edges(eid, src, dst, ts) and feats(node, x0, x1); the result is {p}o(node, x0, x1)."""
    return f""", {p}k AS (SELECT r.eid, r.dst, d.x0 AS o0, d.x1 AS o1, {", ".join(f"{lin(QIN, WQ, j)} AS q{j}, {lin(KIN, WK, j)} AS k{j}, {lin(KIN, WV, j)} AS v{j}" for j in range(2))} FROM {edges} r JOIN {feats} s ON s.node = r.src JOIN {feats} d ON d.node = r.dst),
{p}s AS (SELECT *, (q0 * k0 + q1 * k1) / sqrt(2.0::DOUBLE) AS raw FROM {p}k), {p}l AS (SELECT *, CASE WHEN raw >= 0 THEN raw ELSE raw * 0.2 END AS score FROM {p}s), {p}x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY dst)) AS x FROM {p}l), {p}a AS (SELECT *, x / sum(x) OVER (PARTITION BY dst) AS alpha FROM {p}x),
{p}h AS (SELECT dst AS node, sum(v0 * alpha) AS a0, sum(v1 * alpha) AS a1, any_value(o0) AS o0, any_value(o1) AS o1 FROM {p}a GROUP BY dst), {p}u AS (SELECT node, {", ".join(f"greatest({lin(['a0', 'a1', 'o0', 'o1'], WO, j)}, 0) AS y{j}" for j in range(2))} FROM {p}h),
{p}n AS (SELECT *, (y0 + y1) / 2 AS mu FROM {p}u), {p}o AS MATERIALIZED (SELECT node, (y0 - mu) / sqrt(((y0 - mu) ** 2 + (y1 - mu) ** 2) / 2 + 1e-5) AS x0, (y1 - mu) / sqrt(((y0 - mu) ** 2 + (y1 - mu) ** 2) / 2 + 1e-5) AS x1 FROM {p}n)"""


@query("attention_layer", NODES + FEATS + attention("e", "ft", "at1") + " SELECT node, round(x0, 4) AS h0, round(x1, 4) AS h1 FROM at1o")
def _(t: Tables):
    e = t.purchase_edges().withColumn("dt", F.lit(4000) - F.col("ts"))
    return rounded(M.attention_layer(e, features2(t, e), WQ, WK, WV, WO), "x", 2, digits=4)


@query("graph_attention", NODES + FEATS + ", rv AS (SELECT eid, src, dst, ts FROM e UNION ALL SELECT eid, dst, src, ts FROM e)" + attention("rv", "ft", "at1") + ", f2 AS MATERIALIZED (SELECT node, greatest(x0, 0) AS x0, greatest(x1, 0) AS x1 FROM at1o)" + attention("rv", "f2", "at2") + " SELECT node, round(x0, 4) AS h0, round(x1, 4) AS h1 FROM at2o")
def _(t: Tables):
    e = E.reverse_edges(t.purchase_edges().withColumn("dt", F.lit(4000) - F.col("ts")))
    return rounded(M.graph_attention(e, features2(t, e), [(WQ, WK, WV, WO)] * 2), "x", 2, digits=4)


@query("input_select", NODES + FEATS + " SELECT node, round(CASE WHEN node % 4 = 0 THEN x0 ELSE x1 END, 6) AS x, node % 4 <> 0 AS fell_back FROM ft")
def _(t: Tables):
    n = E.nodes(t.purchase_edges())
    x = node_features(t, n)
    one = lambda i: x.select("node", F.get("x", F.lit(i)).alias("x"))
    return M.input_select(n, one(0).filter(F.col("node") % 4 == 0), one(1)).withColumn("x", F.round("x", 6))


WS, WD, WL = V.weights(4, 3, 1), V.weights(4, 3, 6), V.weights(3, 1, 2)


@query("edge_predictor", NODES + FEATS + ", h AS (SELECT eid, " + ", ".join(f"greatest({lin(['s.x0', 's.x1', 's.x2', 's.x3'], WS, j)} + {lin(['d.x0', 'd.x1', 'd.x2', 'd.x3'], WD, j)}, 0) AS y{j}" for j in range(3)) + f" FROM e JOIN ft s ON s.node = src JOIN ft d ON d.node = dst) SELECT eid, round({lin(['y0', 'y1', 'y2'], WL, 0)}, 5) AS logit FROM h")
def _(t: Tables):
    e = t.purchase_edges()
    return M.edge_predictor(e.select("eid", "src", "dst"), node_features(t, E.nodes(e)), WS, WD, WL).select("eid", F.round("logit", 5).alias("logit"))


GG, GC = V.weights(4, 4, 2), V.weights(4, 2, 7)
SIG = "(1 / (1 + exp(-{})))"
GRU = f"WITH m AS ({EMB}), g AS (SELECT *, " + ", ".join(f"{SIG.format(lin(X4, GG, j))} AS g{j}" for j in range(4)) + " FROM m), c AS (SELECT *, " + ", ".join(f"tanh({lin(['x0', 'x1', 'g2 * x2', 'g3 * x3'], GC, j)}) AS n{j}" for j in range(2)) + " FROM g)"


@query("gru_cell", GRU + " SELECT vec_id, " + ", ".join(f"round((1 - g{j}) * n{j} + g{j} * x{j + 2}, 6) AS h{j}" for j in range(2)) + " FROM c")
def _(t: Tables):
    x = F.col("x")
    return rounded(emb(t).select("vec_id", V.gru_cell(F.slice(x, 1, 2), F.slice(x, 3, 2), GG, GC).alias("h")), "h", 2, digits=6)


LG = V.weights(4, 8, 1)
LSTM = f"WITH m AS ({EMB}), g AS (SELECT *, " + ", ".join(f"{lin(X4, LG, j)} AS g{j}" for j in range(8)) + " FROM m), c AS (SELECT *, " + ", ".join(f"{SIG.format(f'g{2 + j}')} * 0.5::DOUBLE + {SIG.format(f'g{j}')} * tanh(g{6 + j}) AS c{j}" for j in range(2)) + " FROM g)"


@query("lstm_cell", LSTM + " SELECT vec_id, " + ", ".join(f"round({SIG.format(f'g{4 + j}')} * tanh(c{j}), 6) AS h{j}, round(c{j}, 6) AS c{j}" for j in range(2)) + " FROM c")
def _(t: Tables):
    x = F.col("x")
    h, c = V.lstm_cell(F.slice(x, 1, 2), F.slice(x, 3, 2), F.array(F.lit(0.5), F.lit(0.5)), LG)
    return emb(t).select("vec_id", *[F.round(F.get(v, F.lit(j)), 6).alias(f"{n}{j}") for n, v in (("h", h), ("c", c)) for j in range(2)])


def carried(rows: str) -> str:
    """CTE cy(node, i, h0, h1, c0, c1): the LSTM state of two numbers along rows(node, i, x0, x1), i from 1."""
    gates = ", ".join(f"{lin(['x0', 'x1', 'h0', 'h1'], LG, j)} AS g{j}" for j in range(8))
    cells = ", ".join(f"{SIG.format(f'g{2 + j}')} * c{j} + {SIG.format(f'g{j}')} * tanh(g{6 + j}) AS n{j}" for j in range(2))
    return f""", cy AS (WITH RECURSIVE st AS (SELECT DISTINCT node, 0::BIGINT AS i, 0::DOUBLE AS h0, 0::DOUBLE AS h1, 0::DOUBLE AS c0, 0::DOUBLE AS c1 FROM {rows} UNION ALL
  SELECT node, i, {", ".join(f"{SIG.format(f'g{4 + j}')} * tanh(n{j})" for j in range(2))}, n0, n1 FROM (SELECT *, {cells} FROM (SELECT st.node, r.i, c0, c1, {gates} FROM st JOIN {rows} r ON r.node = st.node AND r.i = st.i + 1))) SELECT * FROM st),
la AS (SELECT node, arg_max(h0, i) AS h0, arg_max(h1, i) AS h1 FROM cy GROUP BY node)"""


CARRY = FEAT + ", fx AS MATERIALIZED (SELECT node, row_number() OVER (PARTITION BY node ORDER BY snap) AS i, ln(1 + in_w) AS x0, ln(1 + out_w) AS x1 FROM f)" + carried("fx")


@query("snap_state_carry", CARRY + " SELECT node, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM la")
def _(t: Tables):
    from ..operators.stats import snapshot_features
    from .q_stats import snaps

    x = snapshot_features(snaps(t)).select("node", "snap", F.transform("x", lambda v: F.log1p(v)).alias("x"))
    return rounded(T.lstm_over_snapshots(x, V.weights(4, 8, 1), 2), "h", 2, digits=6)


M1, M2, MY = V.weights(2, 3, 1), V.weights(3, 2, 2), V.weights(2, 1, 3)
MPNN = SNAP + f""", iw AS (SELECT snap, dst, sum(w) AS iw FROM s GROUP BY 1, 2), ow AS (SELECT snap, src, sum(w) AS ow FROM s GROUP BY 1, 2), g AS (SELECT snap, src, dst, w / sqrt(iw * ow) AS norm FROM s JOIN iw USING (snap, dst) JOIN ow USING (snap, src)),
bo AS MATERIALIZED (SELECT snap, src, dst, norm FROM g UNION ALL SELECT snap, dst, src, norm FROM g), p1 AS (SELECT snap, dst AS node, sum(norm) AS q0, sum((src % 7) / 7.0::DOUBLE * norm) AS q1 FROM bo GROUP BY 1, 2),
l1 AS MATERIALIZED (SELECT snap, node, {", ".join(f"greatest({lin(['q0', 'q1'], M1, j)}, 0) AS y{j}" for j in range(3))} FROM p1), p2 AS (SELECT bo.snap, bo.dst AS node, {", ".join(f"sum(y{i} * norm) AS z{i}" for i in range(3))} FROM bo JOIN l1 ON l1.snap = bo.snap AND l1.node = bo.src GROUP BY 1, 2),
fx AS MATERIALIZED (SELECT node, row_number() OVER (PARTITION BY node ORDER BY snap) AS i, {", ".join(f"{lin(['z0', 'z1', 'z2'], M2, j)} AS x{j}" for j in range(2))} FROM p2)""" + carried("fx")


@query("mpnn_lstm", MPNN + f" SELECT node, round({lin(['greatest(h0, 0)', 'greatest(h1, 0)'], MY, 0)}, 6) AS y FROM la")
def _(t: Tables):
    from .q_stats import snaps

    e = snaps(t)
    per = M.gcn_norm(e.withColumns({"src": F.struct("snap", F.col("src").alias("n")), "dst": F.struct("snap", F.col("dst").alias("n"))}))
    both = E.reverse_edges(per.select("src", "dst", "norm"))
    nodes = both.select(F.col("src").alias("node")).distinct()
    x = nodes.select("node", F.array(F.lit(1.0), ((F.col("node.n") % 7) / 7).cast("double")).alias("x"))
    h = M.gcn(both, x, [V.weights(2, 3, 1), V.weights(3, 2, 2)]).select(F.col("node.n").alias("node"), F.col("node.snap").alias("snap"), "x")
    out = T.lstm_over_snapshots(h, V.weights(4, 8, 1), 2)
    return out.select("node", F.round(F.get(V.linear(F.transform("h", V.relu), V.weights(2, 1, 3)), F.lit(0)), 6).alias("y"))


# State.

MAIL = NODES + FEATS + """, b AS (SELECT ts // 200 AS batch, * FROM e), r AS (SELECT batch, eid, ts, w, 0 AS side, src AS node, dst AS other FROM b UNION ALL SELECT batch, eid, ts, w, 1, dst, src FROM b),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch, node ORDER BY ts DESC, eid DESC, side DESC) AS k FROM r) WHERE k = 1)"""


def events(t: Tables):
    e = t.purchase_edges()
    return e, e.select(F.expr("ts div 200").alias("batch"), "eid", "src", "dst", "ts", F.array("w").alias("feat"))


def memory(t: Tables, e, d: int = 2):
    return node_features(t, E.nodes(e), d).select("node", F.col("x").alias("h"))


@query("mail_messages", MAIL + " SELECT batch, l.node, ts, eid, a.x0 AS m0, a.x1 AS m1, c.x0 AS m2, c.x1 AS m3, w AS m4 FROM l JOIN ft a ON a.node = l.node JOIN ft c ON c.node = other")
def _(t: Tables):
    e, ev = events(t)
    m = T.mail_messages(ev, memory(t, e))
    return m.select("batch", "node", "ts", "eid", *[F.get("mail", F.lit(i)).alias(f"m{i}") for i in range(5)])


BOX = MAIL + ", bx AS (SELECT node, (i - 1) % 3 AS slot, ts, eid AS pos FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, eid) AS i, count(*) OVER (PARTITION BY node) AS n FROM l) WHERE i > n - 3)"


def box(t: Tables):
    e, ev = events(t)
    m = T.mail_messages(ev, memory(t, e))
    return e, T.mailbox(m.select("node", "ts", F.col("eid").alias("pos"), "mail"), 3)


@query("mailbox_write", BOX + " SELECT * FROM bx")
def _(t: Tables):
    return box(t)[1].select("node", "slot", "ts", "pos")


@query("mailbox_read", BOX + " SELECT n.node, s AS slot, bx.ts, bx.pos FROM n CROSS JOIN (SELECT unnest(range(3)) AS s) LEFT JOIN bx ON bx.node = n.node AND bx.slot = s")
def _(t: Tables):
    e, b = box(t)
    return T.mailbox_read(E.nodes(e), b, 3).select("node", "slot", "ts", "pos")


UG, UC, UX = V.weights(9, 4, 2), V.weights(9, 2, 7), V.weights(2, 2, 3)
MAILED = ["h0", "h1", "o0", "o1", "w", "cos(ts::DOUBLE)", "cos(ts * 1e-9::DOUBLE)"]
#: Memory of each node after its last message: a GRU over the message and the time since 0.
MEMORY = NODES + FEATS + f""", r AS (SELECT eid, ts, w, 0 AS side, src AS node, dst AS other FROM e UNION ALL SELECT eid, ts, w, 1, dst, src FROM e),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, eid DESC, side DESC) AS k FROM r) WHERE k = 1),
i AS (SELECT l.node, ts, w, a.x0 AS h0, a.x1 AS h1, c.x0 AS o0, c.x1 AS o1 FROM l JOIN ft a ON a.node = l.node JOIN ft c ON c.node = other),
ga AS (SELECT *, {", ".join(f"{SIG.format(lin([*MAILED, 'h0', 'h1'], UG, j))} AS g{j}" for j in range(4))} FROM i), ca AS (SELECT *, {", ".join(f"tanh({lin([*MAILED, 'g2 * h0', 'g3 * h1'], UC, j)}) AS n{j}" for j in range(2))} FROM ga),
me AS MATERIALIZED (SELECT node, {", ".join(f"(1 - g{j}) * n{j} + g{j} * h{j} AS x{j}" for j in range(2))}, ts FROM ca)"""


@query("memory_update", MEMORY + " SELECT node, ts, round(x0, 6) AS h0, round(x1, 6) AS h1 FROM me")
def _(t: Tables):
    e, ev = events(t)
    mem = memory(t, e).withColumn("ts", F.lit(0).cast("long"))
    last = T.mail_messages(ev.withColumn("batch", F.lit(0)), memory(t, e))
    return rounded(T.memory_update(mem, last, V.weights(9, 4, 2), V.weights(9, 2, 7)), "h", 2, digits=6)


@query("mailbox_reset", BOX + " SELECT node, slot, pos, 0::BIGINT AS ts, 0.0::DOUBLE AS m0 FROM bx")
def _(t: Tables):
    return T.mailbox_reset(box(t)[1]).select("node", "slot", "pos", "ts", F.get("mail", F.lit(0)).alias("m0"))


@query("state_write", NODES + FEATS + " SELECT node, CASE WHEN node % 4 = 1 THEN x0 * 2 ELSE x0 END AS x FROM ft")
def _(t: Tables):
    s = node_features(t, E.nodes(t.purchase_edges())).select("node", F.get("x", F.lit(0)).alias("x"))
    return T.state_write(s, s.filter(F.col("node") % 4 == 1).withColumn("x", F.col("x") * 2))


@query("broadcast_update", NODES + ", halo AS (SELECT DISTINCT b.part AS target, src AS node FROM e JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.part <> b.part) SELECT node, count(*)::BIGINT AS pushes FROM halo WHERE node IN (SELECT src FROM e) GROUP BY node")
def _(t: Tables):
    from ..operators import partition as P
    from .q_stats import graph as parted

    e, p = parted(t)
    fresh = e.select(F.col("src").alias("node")).distinct()
    return P.halo_nodes(e, p).join(fresh, "node", "left_semi").groupBy("node").agg(F.count("*").alias("pushes"))


@query("stale_history_read", EDGES + ", h AS (SELECT src AS node, ts // 100 * 100 AS ts, sum(w) AS h FROM e GROUP BY 1, 2), r AS (SELECT DISTINCT src AS node, ts AS t FROM e) SELECT r.node, r.t, h.ts, h.h FROM r ASOF LEFT JOIN h ON h.node = r.node AND h.ts <= r.t")
def _(t: Tables):
    h = t.purchase_edges().groupBy(F.col("src").alias("node"), F.expr("ts div 100 * 100").alias("ts")).agg(F.sum("w").alias("h"))
    return T.stale_history_read(t.roots(), h)


CW = V.weights(4, 2, 3)


@query("compensate", NODES + FEATS + ", a AS (SELECT node, x0, x1, x2, x3, node % 3 - 1 AS age, node % 4 <> 0 AS far FROM ft) SELECT node, " + ", ".join(f"round(CASE WHEN far THEN greatest({lin(['x2', 'x3', 'cos(greatest(age, 0)::DOUBLE)', 'cos(greatest(age, 0) * 1e-9::DOUBLE)'], CW, j)}, 0) ELSE x{j} END, 6) AS h{j}" for j in range(2)) + " FROM a")
def _(t: Tables):
    x = node_features(t, E.nodes(t.purchase_edges()))
    new = T.compensate(F.slice("x", 1, 2), F.slice("x", 3, 2), F.col("node") % 3 - 1, F.col("node") % 4 != 0, CW)
    return rounded(x.select("node", new.alias("h")), "h", 2, digits=6)


@query("compensate_flow", NODES + FEATS + " SELECT node, round(x0 + 0.3::DOUBLE * x2, 6) AS h0, round(x1 + 0.3::DOUBLE * x3, 6) AS h1 FROM ft")
def _(t: Tables):
    x = node_features(t, E.nodes(t.purchase_edges()))
    return rounded(x.select("node", T.compensate_flow(F.slice("x", 1, 2), F.slice("x", 3, 2), F.lit(0.3)).alias("h")), "h", 2, digits=6)


@query("epoch_reset", NODES + " SELECT node, 0::BIGINT AS ts, 0.0::DOUBLE AS h0 FROM n")
def _(t: Tables):
    e = t.purchase_edges()
    return T.epoch_reset(memory(t, e).withColumn("ts", F.lit(5).cast("long"))).select("node", "ts", F.get("h", F.lit(0)).alias("h0"))


@query("tgn_forward", MEMORY + f", tx AS MATERIALIZED (SELECT node, {', '.join(f'x{j} + {lin(["x0", "x1"], UX, j)} AS x{j}' for j in range(2))} FROM me)" + attention("e", "tx", "at1") + " SELECT node, round(x0, 4) AS h0, round(x1, 4) AS h1 FROM at1o")
def _(t: Tables):
    e, ev = events(t)
    mem = T.memory_update(memory(t, e).withColumn("ts", F.lit(0).cast("long")), T.mail_messages(ev.withColumn("batch", F.lit(0)), memory(t, e)), V.weights(9, 4, 2), V.weights(9, 2, 7))
    x = mem.select("node", V.add(F.col("h"), V.linear(F.col("h"), V.weights(2, 2, 3))).alias("x"))
    return rounded(M.attention_layer(e.withColumn("dt", F.lit(4000) - F.col("ts")), x, WQ, WK, WV, WO), "x", 2, digits=4)


# Losses and metrics.

SCORED = EDGES + ", s AS (SELECT eid // 500 AS batch, eid, round(((eid * 7919 + src * 31) % 1000) / 500.0::DOUBLE - 1 + label * 0.4::DOUBLE, 6) AS score, label FROM e)"


def scored(t: Tables):
    raw = ((F.col("eid") * 7919 + F.col("src") * 31) % 1000) / 500 - 1 + F.col("label") * 0.4
    return t.purchase_edges().select(F.expr("eid div 500").alias("batch"), "eid", F.round(raw, 6).alias("score"), "label")


@query("mse_loss", EDGES + " SELECT round(avg(m), 9) AS mse FROM (SELECT ts // 200 AS snap, avg((w - 25) ** 2) AS m FROM e GROUP BY 1)")
def _(t: Tables):
    rows = t.purchase_edges().select(F.expr("ts div 200").alias("snap"), F.col("w").alias("pred"), F.lit(25.0).alias("y"))
    return M.mse_loss(rows).withColumn("mse", F.round("mse", 9))


@query("bce_logits", SCORED + " SELECT batch, round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 9) AS bce FROM s GROUP BY batch")
def _(t: Tables):
    return M.bce_logits(scored(t).withColumnRenamed("score", "logit"), ("batch",)).withColumn("bce", F.round("bce", 9))


AP = SCORED + """, g AS (SELECT batch, score, sum(label) AS p, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY batch) AS al FROM g WINDOW w AS (PARTITION BY batch ORDER BY score DESC)),
ap AS (SELECT batch, sum(tp * p / (seen * al)::DOUBLE) AS ap FROM c GROUP BY batch),
au AS (SELECT a.batch, avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.batch = b.batch AND a.label = 1 AND b.label = 0 GROUP BY a.batch)"""


@query("average_precision", AP + " SELECT batch, round(ap, 9) AS ap FROM ap")
def _(t: Tables):
    return M.average_precision(scored(t)).withColumn("ap", F.round("ap", 9))


@query("roc_auc", AP + " SELECT batch, round(auc, 9) AS auc FROM au")
def _(t: Tables):
    return M.roc_auc(scored(t)).withColumn("auc", F.round("auc", 9))


@query("epoch_mean", AP + " SELECT round(avg(ap), 9) AS ap, round(avg(auc), 9) AS auc FROM ap JOIN au USING (batch)")
def _(t: Tables):
    s = scored(t)
    both = M.average_precision(s).join(M.roc_auc(s), "batch")
    return both.agg(F.round(F.avg("ap"), 9).alias("ap"), F.round(F.avg("auc"), 9).alias("auc"))
