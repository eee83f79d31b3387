"""Rows that samples send through shuffles: they grow with edges and roots, not with picks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import edges as E
from chronoloom.operators import sampling as S

NODES, EACH = 20, 150


def shuffled(spark, job):
    """Rows written to shuffles while job() runs."""
    gateway = spark.sparkContext._gateway
    jsc = spark.sparkContext._jsc.sc()

    def total():
        jsc.listenerBus().waitUntilEmpty()
        stages = jsc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    job()
    return total() - before


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(n, 1000 + (n * 7 + i) % 40, i, n * EACH + i) for n in range(NODES) for i in range(EACH)]
    return spark.createDataFrame(rows, "src long, dst long, ts long, eid long").cache()


def count(df):
    return df.agg(F.sum(F.hash(*df.columns))).collect()


SAMPLES = {
    "full": (lambda e, r: S.sample_full(e, r, direction="out"), 15),
    "nearest": (lambda e, r: S.sample_nearest(e, r, 8, direction="out"), 12),
    "distinct": (lambda e, r: S.sample_distinct(e, r, 10, direction="out"), 14),
    "khop": (lambda e, r: S.khop_sample(E.reverse_edges(e), r, [10, 10]).filter("layer = 1"), 40),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_rows_shuffled(spark, graph, name):
    sample, most = SAMPLES[name]
    r = graph.select(F.col("src").alias("node"), F.col("ts").alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        got = shuffled(spark, lambda: count(sample(graph, r)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got < most * NODES * EACH


def test_dispatch_takes_each_sample_once():
    assert S.dispatch(["no such policy", 0, "recent", "full", 3, 2]) == {"recent": ["no such policy", 0, "recent"], "full": ["full", 3, 2]}
    assert S.dispatch(["cluster", 1, 3], "d") == {"cluster": ["cluster"], "uniform": [1], "full": [3]}


def test_hot_and_cold_nodes_and_ties(spark):
    """One node with most edges among many small ones, five edges at a time."""
    rows = [(1 if i % 3 else 10 + i // 3 % 700, 5000 + i % 11, i // 5 % 200, i) for i in range(3000)]
    e = spark.createDataFrame(rows, "src long, dst long, ts long, eid long")
    history = S.History(e, "out")
    assert 0 < len(history.hot) < 50
    asks = sorted({(n, t) for n in (1, 10, 11, 400) for t in range(-3, 210, 9)})
    r = spark.createDataFrame(asks + asks, "node long, t long")
    every = {n: sorted((ts, i) for s, _, ts, i in rows if s == n) for n in (1, 10, 11, 400)}
    want = {(n, t, i, k) for n, t in asks for k, (_, i) in enumerate(sorted(every[n], key=lambda x: (abs(x[0] - t), *x))[:3], 1)}
    found = [(x.node, x.t, x.eid, x["rank"]) for x in S.sample_nearest(e, r, 3, direction="out").collect()]
    assert len(found) == len(want) and set(found) == want
    want = {(n, t, i, k) for n, t in asks for k, (_, i) in enumerate([x for x in every[n] if x[0] < t][::-1], 1)}
    found = [(x.node, x.t, x.eid, x["rank"]) for x in S.sample_full(e, r, direction="out").collect()]
    assert len(found) == len(want) and set(found) == want


def test_batch_inputs_shuffle_their_rows_once(spark):
    from chronoloom.operators import batch as B

    n = 4000
    nodes = spark.createDataFrame([(i % 2, i, i % 10, None if i % 50 == 9 else i % 50) for i in range(n)], "part long, local_id long, node long, ts long")
    own = lambda schema, *more: spark.createDataFrame([(k, *more) for k in range(9)], schema)
    history = spark.createDataFrame([(k, 20, float(k)) for k in range(10)], "node long, ts long, h double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        tables = own("node long, part long", 1), own("node long, x double", 0.5), own("node long, h double, ts long", 2.5, 7), own("node long, mail double, ts long", 3.5, 8), history
        rows = shuffled(spark, lambda: got.extend(B.batch_inputs(nodes, *tables).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == n and rows < 1.6 * n
    for r in got:
        late, known = r.ts is not None and r.ts >= 20, r.node < 9
        assert (r.hist, r.hist_ts) == ((float(r.node), 20) if late else (None, None))
        assert (r.x, r.mem, r.mem_ts, r.mail, r.mail_ts) == ((0.5, 2.5, 7, 3.5, 8) if known else (None,) * 5)
        assert r.is_remote == (not known or r.part != 1)
