"""Small graphs with answers found by hand."""

from __future__ import annotations

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import vectors as V
from chronoloom.operators import batch as B
from chronoloom.operators import edges as E
from chronoloom.operators import formulas as X
from chronoloom.operators import messages as M
from chronoloom.operators import partition as P
from chronoloom.operators import sampling as S
from chronoloom.operators import windows as W
from chronoloom.sources.adapters import Tables

EDGE = "src long, dst long, ts long, eid long"


def graph(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def roots(spark, rows):
    return spark.createDataFrame(rows, "node long, t long")


def test_chain_two_hops(spark):
    e = graph(spark, [(1, 2, 1, 0), (2, 3, 2, 1), (3, 4, 3, 2)])
    got = S.khop_sample(e, roots(spark, [(4, 10)]), [10, 10, 10]).collect()
    assert sorted((r.layer, r.node, r.nbr, r.ts) for r in got) == [(0, 4, 3, 3), (1, 3, 2, 2), (2, 2, 1, 1)]
    assert all(r.ts < r.t for r in got)


def test_ties_and_strict_bound(spark):
    e = graph(spark, [(1, 2, 5, 0), (1, 3, 5, 1), (1, 4, 5, 2), (1, 5, 6, 3)])
    r = roots(spark, [(1, 5), (1, 6)])
    got = S.sample_recent(e, r, 10, direction="out").collect()
    assert sorted((x.t, x.eid, x["rank"]) for x in got) == [(6, 0, 3), (6, 1, 2), (6, 2, 1)]
    assert S.sample_recent(e, r, 10, direction="out", equal_root_time=True).filter("t = 5").count() == 3


def test_overflow_keeps_newest(spark):
    e = graph(spark, [(1, 100 + t, t, t) for t in range(15)])
    r = roots(spark, [(1, 100), (1, 4)])
    for bucket in (None, 4):
        got = S.sample_recent(e, r, 10, direction="out", time_bucket=bucket).collect()
        assert sorted(x.eid for x in got if x.t == 100) == list(range(5, 15))
        assert sorted(x.eid for x in got if x.t == 4) == [0, 1, 2, 3]
    full = {(x.t, x.eid) for x in S.sample_full(e, r, direction="out").collect()}
    assert {(x.t, x.eid) for x in got} <= full
    assert S.sample_uniform(e, r, 3, direction="out").groupBy("t").count().filter("count <> 3").count() == 0


def test_no_history_and_empty(spark):
    e = graph(spark, [(1, 2, 1, 0)])
    assert S.sample_recent(e, roots(spark, [(9, 5)]), 3).count() == 0
    none = graph(spark, [])
    assert S.sample_recent(none, roots(spark, [(9, 5)]), 3).count() == 0
    assert W.slot_boundaries_by_event(none, 3) == []


def test_self_loops_and_parallels(spark):
    e = graph(spark, [(1, 1, 1, 0), (1, 2, 2, 1), (1, 2, 3, 2)])
    assert E.simple_graph(e).count() == 2
    assert E.drop_self_loops(e).count() == 2
    assert sorted(r.eid for r in E.reverse_edges(e).collect()) == [0, 0, 1, 1, 2, 2]
    assert {(r.src, r.dst) for r in E.bidirect(e).collect()} == {(1, 1), (1, 2), (2, 1)}


def test_halo_and_routes(spark):
    parts = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "node long, part long")
    e = graph(spark, [(1, 3, 1, 0), (3, 2, 2, 1)])
    assert {(r.part, r.node) for r in P.halo_nodes(e, parts).collect()} == {(0, 3), (1, 1)}
    book = P.partition_book(e, parts)
    assert book.filter("is_owned").count() == 4 and book.count() == 6
    lists = P.send_lists(e, parts).collect()
    assert {(r.sender, r.receiver, r.node) for r in lists} == {(1, 0, 3), (0, 1, 1)}


def test_interval(spark):
    e = graph(spark, [(t, 1, t, t) for t in range(10)])
    got = S.sample_window(e, roots(spark, [(1, 5)]), -3, 0).collect()
    assert sorted(r.eid for r in got) == [2, 3, 4] and {r.ts for r in got} == {5}
    assert [r.eid for r in S.sample_window(e, roots(spark, [(1, 5)]), -3, 0, k=1).collect()] == [2]
    with pytest.raises(ValueError):
        S.sample(e, roots(spark, [(1, 5)]), "recent", graph_type="d")


def test_slots(spark):
    e = graph(spark, [(0, 1, t, t * 3 + i) for t in range(10) for i in range(3)])
    b = W.slot_boundaries_by_event(e, 7)
    assert b == [0, 2, 5, 8, 10]
    placed = W.slot_assign(e, b)
    assert placed.filter("slot IS NULL").count() == 0 and placed.filter("slot = 3").count() == 6


def test_geometric_schedule():
    assert W.geometric_schedule(4, 3) == [4, 2, 1]
    assert W.geometric_schedule(7, 1) == [7] and W.geometric_schedule(7, 0) == []
    for top in (1, 2, 9, 100):
        for n in range(2, 9):
            got = W.geometric_schedule(top, n)
            assert len(got) == n and got[0] == top and got[-1] == 1 and got == sorted(got, reverse=True)


def test_parse_shares():
    assert W.parse_shares("0.5, 0.25,,0.25 ") == [0.5, 0.25, 0.25]
    for text in ("0.25,0.5", "0,1", "1.5"):
        with pytest.raises(ValueError):
            W.parse_shares(text)


def test_decay():
    assert W.chunk_decay("auto:0.5", 8, 4, 1) == [4, 2, 1]
    assert W.chunk_decay("AUTO:2", 8, 3, 2) == [8] and W.chunk_decay("auto:0", 8, 4, 1) == []
    assert W.chunk_decay("0.5,0.25", 16, 4, 2) == [8, 4]
    assert W.chunk_decay("0.5,0.25,0.1", 10, 4, 2) == [5, 3]
    assert W.chunk_decay("", 16, 2, 2) == []
    for pattern, fulls in (("0.5", 2), ("0.25,0.5", 2), ("0.5,0.5", 5)):
        with pytest.raises(ValueError):
            W.chunk_decay(pattern, 16, 4, fulls)


def test_packed_ids_round_trip(spark):
    df = spark.createDataFrame([(3, 77, True), (16383, (1 << 48) - 1, False)], "p long, l long, s boolean")
    packed = df.withColumn("d", P.pack_dist_id(df.p, df.l, df.s))
    part, loc, shared = P.unpack_dist_id(packed.d)
    assert packed.filter(~((part == packed.p) & (loc == packed.l) & (shared == packed.s))).count() == 0


def test_rebuild_and_remap(spark):
    e = graph(spark, [(1, 2, 1, 0), (2, 3, 2, 1), (1, 2, 2, 2)])
    back = B.rebuild_events(B.nested_roots(E.interleave_reverse(e)))
    assert {tuple(r) for r in back.select("src", "dst", "ts", "eid").collect()} == {tuple(r) for r in e.collect()}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "gid long")
    m = B.remap_ids(B.remap_ids(None, ids(5, 9)), ids(9, 1, 7))
    assert {(r.gid, r.local_id) for r in m.collect()} == {(5, 0), (9, 1), (1, 2), (7, 3)}
    assert {r.gid for r in B.remap_ids(m, ids(4), reset=True).collect()} == {4}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.9, 1), (0, 0.8, 0), (0, 0.4, 1), (0, 0.3, 0)], "batch int, score double, label int")
    assert round(M.average_precision(df).first()["ap"], 4) == 0.8333
    assert M.roc_auc(df).first()["auc"] == 0.75
    squeezed = df.withColumn("score", df.score / 10 + 3)
    assert M.roc_auc(squeezed).first()["auc"] == 0.75
    assert M.roc_auc(df.filter("label = 1")).first()["auc"] is None


def test_vectors(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(V.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), V.layer_norm(F.array(F.lit(1.0), F.lit(3.0))).alias("n"), V.linear(F.array(F.lit(1.0), F.lit(2.0)), [[1.0], [10.0]]).alias("l")).first()
    assert row["s"] == [0.5, 0.5] and row["l"] == [21.0] and abs(row["n"][1] - 1) < 1e-3


# Numbers without a single task.


def test_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.randrange(5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, a long, b long").repartition(5)
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    got = E.assign_position(df, ["a", "b"], "i")
    assert [(r.a, r.b) for r in got.orderBy("i").collect()] == sorted((a, b) for _, a, b in rows)
    assert sorted(r.i for r in got.collect()) == list(range(3000))
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    within = E.position_within(df, ["g"], ["a", "b"], "i", keep=("b",)).collect()
    for g in (None, 1, 2, 3):
        mine = sorted((r.i, r.b) for r in within if r.g == g)
        assert [b for _, b in mine] == [b for _, a, b in sorted((r for r in rows if r[0] == g), key=order)] and [i for i, _ in mine] == list(range(len(mine)))
    total = {r.b: r.s for r in E.running_total(df, ["b"], "a", "s").collect()}
    upto = 0
    for _, a, b in sorted(rows, key=lambda r: r[2]):
        upto += a
        assert total[b] == upto
    assert E.assign_position(df.limit(0), ["a"], "i").count() == E.position_within(df.limit(0), ["g"], ["a"], "i").count() == 0


def test_greedy_slots_equal_a_walk(spark):
    rng = random.Random(2)
    for per_slot in (1, 4, 30, 5000):
        ts = sorted(rng.choice([rng.randrange(400), 77, 78]) for _ in range(900))
        e = graph(spark, [(0, 1, t, i) for i, t in enumerate(ts)])
        want, seen, goal = [ts[0]], 0, per_slot
        for t in sorted(set(ts)):
            seen += ts.count(t)
            if seen >= goal:
                want += [t] * (t != want[-1])
                goal = seen + per_slot
        assert W.slot_boundaries_by_event(e, per_slot) == [*want, ts[-1] + 1], per_slot


# A node with nine tenths of all edges.


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.9 else rng.randrange(2, 9), rng.randrange(20, 32), rng.randrange(300), i) for i in range(2000)]
    asks = sorted({(rng.choice([1, 1, 2, 3, 8, 99]), rng.randrange(-5, 310)) for _ in range(120)})
    return rows, asks, graph(spark, rows).cache(), roots(spark, asks)


def test_hot_node_samples_equal_brute_force(hot):
    rows, asks, e, r = hot
    out = {(n, t): sorted((ts, i, d) for s, d, ts, i in rows if s == n and ts < t) for n, t in asks}
    upto = {(n, t): sorted((ts, i, d) for s, d, ts, i in rows if s == n and ts <= t) for n, t in asks}
    every = {n: [(ts, i, d) for s, d, ts, i in rows if s == n] for n in range(100)}
    brute = lambda pick: sorted((n, t, i, k + 1) for (n, t) in asks for k, (_, i, _) in enumerate(pick(n, t)))
    found = lambda df: sorted((x.node, x.t, x.eid, x["rank"]) for x in df.collect())
    for bucket in (None, 1, 7, 1000):
        assert found(S.sample_recent(e, r, 10, direction="out", time_bucket=bucket)) == brute(lambda n, t: out[n, t][::-1][:10])
    assert found(S.sample_recent(e, r, 4, direction="out", equal_root_time=True, window=9)) == brute(lambda n, t: [x for x in upto[n, t] if x[0] >= t - 9][::-1][:4])
    assert found(S.sample_window(e, r, -20, 0, direction="out")) == brute(lambda n, t: [x for x in out[n, t] if x[0] >= t - 20])
    assert found(S.sample_nearest(e, r, 5, direction="out")) == brute(lambda n, t: sorted(every[n], key=lambda x: (abs(x[0] - t), x[0], x[1]))[:5])
    full = {(x.node, x.t): x.n for x in S.sample_full(e, r, direction="out").groupBy("node", "t").agg(F.count("*").alias("n")).collect()}
    assert full == {k: len(v) for k, v in out.items() if v}

    def distinct(n, t, k):
        last = {d: (ts, i, d) for ts, i, d in upto[n, t]}
        return sorted(last.values(), reverse=True)[:k]

    for k in (3, 12, 20):
        assert found(S.sample_distinct(e, r, k, direction="out")) == brute(lambda n, t: distinct(n, t, k))


def test_hot_node_is_spread(hot):
    _, _, e, r = hot
    rows = S.History(e, "out").rows
    assert "SinglePartition" not in S.sample_recent(e, r, 3, direction="out")._jdf.queryExecution().toString()
    stretches = e.filter("src = 1").groupBy(F.floor(F.col("ts") / (299 // S.STRETCHES + 1))).count().agg(F.max("count")).first()[0]
    assert rows.count() == e.count() and stretches < 100


def test_uniform_draws_are_uniform(spark):
    n, k = 12, 4
    e = graph(spark, [(node, 100 + t, t, node * n + t) for node in range(600) for t in range(n)])
    got = S.sample_uniform(e, roots(spark, [(node, 50) for node in range(600)]), k, direction="out").collect()
    assert len(got) == 600 * k == len({(x.node, x.eid) for x in got})
    counts = collections.Counter(x.ts for x in got)
    assert len(counts) == n and all(abs(c - 200) < 60 for c in counts.values())
    both = collections.Counter(p for node in range(600) for p in itertools.combinations(sorted(x.ts for x in got if x.node == node), 2))
    assert len(both) == n * (n - 1) // 2 and max(both.values()) < 100 and min(both.values()) > 25  # 54.5 on average


# Partitioners.


def blocks(n, size, rng, inner=4, outer=0.2):
    """Edges of n groups of `size` nodes, most of them inside a group."""
    rows = []
    for i in range(n * size):
        for _ in range(inner):
            rows.append((i, i // size * size + rng.randrange(size)))
        if rng.random() < outer:
            rows.append((i, rng.randrange(n * size)))
    return [(a * 7919 % 100_003, b * 7919 % 100_003, k, k) for k, (a, b) in enumerate(rows) if a != b]


def modularity(rows, cluster, resolution):
    pairs = {(min(a, b), max(a, b)) for a, b, *_ in rows}
    deg, m = collections.Counter(x for p in pairs for x in p), len(pairs)
    per = collections.Counter()
    for x, d in deg.items():
        per[cluster[x]] += d
    return sum(cluster[a] == cluster[b] for a, b in pairs) * resolution / m - sum(d * d for d in per.values()) / (2 * m) ** 2


def test_modularity_clusters(spark):
    rows = blocks(8, 30, random.Random(4))
    got = {r.node: r.cluster for r in P.modularity_clusters(graph(spark, rows), resolution=1.0, rounds=6).collect()}
    truth = {x * 7919 % 100_003: x // 30 for x in range(240)}
    alone = {x: x for x in got}
    one = dict.fromkeys(got, 0)
    assert set(got) == set(truth) & set(got) and modularity(rows, got, 1.0) > max(0.6 * modularity(rows, truth, 1.0), modularity(rows, alone, 1.0), modularity(rows, one, 1.0))


def cut_of(rows, part):
    return sum(part[a] != part[b] for a, b, *_ in rows)


@pytest.mark.parametrize("by_edges", [True, False])
def test_balanced_partition(spark, by_edges):
    rows = blocks(16, 40, random.Random(5))
    e = graph(spark, rows)
    part = {r.node: r.part for r in P.balanced_partition(e, 4, by_edges=by_edges).collect()}
    load = collections.Counter()
    for a, b, *_ in rows:
        for x in (a, b):
            load[part[x]] += by_edges
    for x in part:
        load[part[x]] += not by_edges
    assert set(part) == {x for r in rows for x in r[:2]} and sorted(load) == [0, 1, 2, 3]
    assert max(load.values()) <= 1.05 * sum(load.values()) / 4
    assert cut_of(rows, part) < 0.5 * cut_of(rows, {x: hash((x, 1)) % 4 for x in part})


def test_balanced_partition_in_groups_and_on_purchases(spark, sf_dir):
    rows = blocks(8, 30, random.Random(6))
    e = graph(spark, rows)
    groups = E.nodes(e).withColumn("group", F.col("node") % 2)
    got = P.balanced_partition(e, 3, groups=groups, by_edges=False).collect()
    sizes = collections.Counter((r.group, r.part) for r in got)
    assert len(got) == groups.count() and all(r.group == r.node % 2 for r in got) and len(sizes) == 6
    assert max(sizes.values()) <= min(sizes.values()) * 1.1 + 2
    bought = Tables(spark, sf_dir).purchase_edges()
    pairs = [(r.src, r.dst) for r in bought.select("src", "dst").collect()]
    part = {r.node: r.part for r in P.balanced_partition(bought, 4).collect()}
    load = collections.Counter(part[x] for p in pairs for x in p)
    assert max(load.values()) <= 1.05 * sum(load.values()) / 4
    assert cut_of(pairs, part) < cut_of(pairs, {x: x * 2654435761 % 2**32 * 4 // 2**32 for x in part})
    assert P.balanced_partition(e.limit(0), 4).count() == 0


def test_rcm_with_halo(spark):
    """A path whose ends have many neighbours outside: these count for degrees, so the walk starts inside."""
    inner = [(i, i + 1) for i in range(6)]
    halo = [(0, 100 + i) for i in range(5)] + [(6, 200 + i) for i in range(5)]
    e = graph(spark, [(a, b, 0, i) for i, (a, b) in enumerate(inner + halo)])
    b = spark.createDataFrame([(i, 0, 0) for i in range(7)], "node long, part long, bucket long")
    got = [r.node for r in P.rcm_order(e, b).orderBy("ord").collect()]
    degree = {0: 6, 6: 6} | {i: 2 for i in range(1, 6)}
    order, queue = [], [1]
    while queue:
        x = queue.pop(0)
        order.append(x)
        queue += sorted((y for y in (x - 1, x + 1) if 0 <= y <= 6 and y not in order and y not in queue), key=lambda y: (degree[y], y))
    assert got == order[::-1]
    pieces = P.rcm_order(e, b, limit=3).orderBy("ord").collect()
    assert [r.ord for r in pieces] == list(range(7)) and {r.node for r in pieces[:3]} == {0, 1, 2}


# Formulas over long histories.


def test_decayed_sums_equal_a_walk(spark):
    rng = random.Random(7)
    steps = [(n, i * (1 + n), rng.randrange(9)) for n in range(3) for i in range(2500 if n == 1 else 40)]
    for alpha in (0.01, 0.25, 0.9, 1.0):
        got = {(r.node, r.step): r.heat for r in X.ema(spark.createDataFrame(steps, "node long, step long, deg long"), alpha).collect()}
        h = collections.defaultdict(float)
        for n, i, v in steps:
            h[n] = alpha * v + (1 - alpha) * h[n]
            assert abs(got[n, i] - h[n]) < 1e-9
    times = sorted(rng.choice([rng.randrange(50), rng.randrange(40_000)]) for _ in range(1500))
    for omega in (0.01, 3.0):
        got = {r.ts: r.intensity for r in X.hawkes_intensity(spark.createDataFrame([(1, 2, t) for t in times], "src long, dst long, ts long"), 0.1, 0.5, omega).collect()}
        level, last = 0.0, times[0]
        for t in sorted(set(times)):
            level *= math.exp(-omega * (t - last))
            assert abs(got[t] - 0.1 - level) < 1e-9
            level, last = level + 0.5 * times.count(t), t


def test_knapsack_passes_over_what_does_not_fit(spark):
    rng = random.Random(8)
    rows = [(i, float(rng.randrange(1, 50)), rng.choice([1, 2, 7, 19, 60])) for i in range(200)]
    for budget in (0, 5, 100, 333):
        used, want = 0, []
        for i, s, z in sorted(rows, key=lambda r: (-round(r[1] / r[2], 9), r[0])):
            if used + z <= budget:
                used += z
                want.append((i, used))
        got = X.cache_budget(spark.createDataFrame(rows, "node long, score double, size long"), budget)
        assert sorted((r.upto, r.node) for r in got.collect()) == sorted((u, i) for i, u in want)
