"""Owners, halos, replicas, routes, packed ids, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import partition as P
from ..operators import stats as S
from ..sources.adapters import Tables, node_parts
from .define import EDGES, NODES, query
from .q_edges import HOT
from .q_stats import BOOK, graph

FEATS = ", vn AS (SELECT node, node % c AS vec_id FROM n, (SELECT count(*) AS c FROM embeddings)), ft AS MATERIALIZED (SELECT node, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS x3 FROM vn JOIN embeddings USING (vec_id))"


#: All numbers of a node's embedding, as a list.
WHOLE = ", fw AS MATERIALIZED (SELECT node, embedding::DOUBLE[] AS x FROM vn JOIN embeddings USING (vec_id))"


def node_features(t: Tables, nodes, d: int | None = 4):
    """node, x: the first d numbers of the node's embedding, or all."""
    v = t.table("embeddings")
    n = v.count()
    x = v.select("vec_id", F.transform(F.slice("embedding", 1, d) if d else F.col("embedding"), lambda a: a.cast("double")).alias("x"))
    return nodes.withColumn("vec_id", F.col("node") % n).join(x, "vec_id").select("node", "x")


def book(t: Tables):
    return P.partition_book(*graph(t))


@query("partition_book", BOOK + " SELECT part, loc, node, is_owned FROM book")
def _(t: Tables):
    return book(t).select("part", "loc", "node", "is_owned")


@query("halo_nodes", BOOK + " SELECT part, node, owner FROM halo")
def _(t: Tables):
    return P.halo_nodes(*graph(t))


@query("outer_nodes", NODES + HOT + " SELECT DISTINCT part, dst AS node FROM e JOIN p ON p.node = src WHERE dst NOT IN (SELECT node FROM h) AND dst % 4 <> part")
def _(t: Tables):
    e, p = graph(t)
    return P.outer_nodes(e, p, S.hot_nodes(e, 0.1))


@query("edge_owner_dst", NODES + " SELECT eid, part FROM e JOIN p ON p.node = dst")
def _(t: Tables):
    return P.edge_owner(*graph(t)).select("eid", "part")


@query("edge_owner_src", NODES + " SELECT eid, part FROM e JOIN p ON p.node = src")
def _(t: Tables):
    return P.edge_owner(*graph(t), by="src").select("eid", "part")


@query("replica_lookup", BOOK + " SELECT eid AS pos, node, part AS rank, loc FROM e JOIN book ON node = src")
def _(t: Tables):
    e, p = graph(t)
    return P.replica_lookup(e.select(F.col("eid").alias("pos"), F.col("src").alias("node")), P.replicas(P.partition_book(e, p))).select("pos", "node", "rank", "loc")


@query("g2l_lookup", BOOK + ", q AS (SELECT node, part FROM n, (SELECT DISTINCT part FROM p)) SELECT q.part, q.node, coalesce(loc, -1) AS loc FROM q LEFT JOIN book b ON b.node = q.node AND b.part = q.part")
def _(t: Tables):
    e, p = graph(t)
    return P.g2l_lookup(p.select("node"), P.partition_book(e, p)).select("part", "node", "loc")


@query("owner_lookup", NODES + " SELECT eid, a.part AS src_part, b.part AS dst_part FROM e JOIN p a ON a.node = src JOIN p b ON b.node = dst")
def _(t: Tables):
    e, p = graph(t)
    pick = lambda s: p.select(F.col("node").alias(s), F.col("part").alias(f"{s}_part"))
    return e.join(pick("src"), "src").join(pick("dst"), "dst").select("eid", "src_part", "dst_part")


@query("l2d_lookup", BOOK + " SELECT part, loc, o.node, (op << 48) | ol AS dist_id FROM book o JOIN (SELECT node, part AS op, loc AS ol FROM book WHERE is_owned) USING (node)")
def _(t: Tables):
    b = book(t)
    own = b.filter("is_owned").select("node", F.col("part").alias("_p"), F.col("loc").alias("_l"))
    return b.join(own, "node").select("part", "loc", "node", P.pack_dist_id(F.col("_p"), F.col("_l")).alias("dist_id"))


@query("is_master", BOOK + ", m AS (SELECT part, count(*) FILTER (is_owned) AS m FROM book GROUP BY part) SELECT part, node, loc < m AS is_master, loc >= m AS is_remote, loc >= 0 AS is_stored FROM book JOIN m USING (part)")
def _(t: Tables):
    return P.residence(book(t)).select("part", "node", "is_master", "is_remote", "is_stored")


@query("pack_dist_id", BOOK + " SELECT part, loc, (part << 48) | loc | (CASE WHEN NOT is_owned THEN 1::BIGINT << 62 ELSE 0 END) AS dist_id FROM book")
def _(t: Tables):
    return book(t).select("part", "loc", P.pack_dist_id(F.col("part"), F.col("loc"), ~F.col("is_owned")).alias("dist_id"))


@query("unpack_dist_id", BOOK + " SELECT node, part, loc, NOT is_owned AS shared FROM book")
def _(t: Tables):
    packed = book(t).select("node", P.pack_dist_id(F.col("part"), F.col("loc"), ~F.col("is_owned")).alias("d"))
    part, loc, shared = P.unpack_dist_id(F.col("d"))
    return packed.select("node", part.alias("part"), loc.alias("loc"), shared.alias("shared"))


@query("pack_chunk", NODES + " SELECT node, ((part::INT << 16) | cluster::INT)::INT AS packed FROM p")
def _(t: Tables):
    return graph(t)[1].select("node", P.pack_chunk(F.col("part"), F.col("cluster")).alias("packed"))


@query("dist_ids", NODES + ", l AS (SELECT node, part, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS loc FROM p), o AS (SELECT eid, p.part, row_number() OVER (PARTITION BY p.part ORDER BY eid) - 1 AS loc FROM e JOIN p ON p.node = dst) SELECT 'node' AS kind, node AS id, (part << 48) | loc AS dist_id FROM l UNION ALL SELECT 'edge', eid, (part << 48) | loc FROM o")
def _(t: Tables):
    e, p = graph(t)
    number = lambda df, key, kind: E.position_within(df.select("part", key), ["part"], [key], "_l").select(F.lit(kind).alias("kind"), F.col(key).alias("id"), P.pack_dist_id(F.col("part"), F.col("_l")).alias("dist_id"))
    return number(p, "node", "node").unionByName(number(P.edge_owner(e, p), "eid", "edge"))


@query("hot_replication", NODES + HOT + ", x AS (SELECT q.part, node, TRUE AS is_shared FROM h, (SELECT DISTINCT part FROM p) q UNION ALL SELECT part, node, FALSE FROM p WHERE node NOT IN (SELECT node FROM h)) SELECT part, node, is_shared, row_number() OVER (PARTITION BY part ORDER BY is_shared DESC, node) - 1 AS loc FROM x")
def _(t: Tables):
    e, p = graph(t)
    return P.hot_replication(p, S.hot_nodes(e, 0.1)).select("part", "node", "is_shared", "loc")


@query("singleton_clusters", NODES + ", c AS (SELECT node, cluster FROM p WHERE node IN (SELECT src FROM e WHERE ts < 1800)) SELECT * FROM c UNION ALL SELECT node, (SELECT max(cluster) FROM c) + row_number() OVER (ORDER BY node) FROM n WHERE node NOT IN (SELECT node FROM c)")
def _(t: Tables):
    e, p = graph(t)
    early = p.join(e.filter("ts < 1800").select(F.col("src").alias("node")), "node", "left_semi").select("node", "cluster")
    return P.singleton_clusters(p, early)


@query("cluster_louvain")
def _(t: Tables):
    return P.modularity_clusters(t.purchase_edges())


@query("cluster_metis")
def _(t: Tables):
    return P.balanced_partition(t.purchase_edges(), 128, by_edges=False).select("node", "part")


@query("inter_partition")
def _(t: Tables):
    return P.balanced_partition(t.purchase_edges(), 4).select("node", "part")


@query("intra_partition")
def _(t: Tables):
    e, p = graph(t)
    inner = P.balanced_partition(e, 100, groups=p.select("node", F.col("part").alias("group")))
    return inner.select("node", F.col("group").alias("part"), F.col("part").alias("chunk"), P.pack_chunk(F.col("group"), F.col("part")).alias("packed"))


@query("build_route", BOOK + " SELECT owner AS sender, part AS receiver, node, row_number() OVER (PARTITION BY owner, part ORDER BY node) - 1 AS ord FROM halo")
def _(t: Tables):
    return P.send_lists(*graph(t))


@query("single_part_block", NODES + " SELECT node, row_number() OVER (ORDER BY node) - 1 AS loc, TRUE AS is_owned FROM n")
def _(t: Tables):
    e = t.purchase_edges()
    one = E.nodes(e).withColumn("part", F.lit(0).cast("long"))
    return P.partition_book(e, one).select("node", "loc", "is_owned")


@query("halo_fetch", BOOK + FEATS + WHOLE + " SELECT part, node, is_owned, round(list_sum(x), 6) AS x_sum, len(x)::BIGINT AS d FROM book JOIN fw USING (node)")
def _(t: Tables):
    e, p = graph(t)
    rows = P.halo_fetch(node_features(t, p.select("node"), None), e, p)
    return rows.select("part", "node", "is_owned", F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("x_sum"), F.size("x").cast("long").alias("d"))


@query("reverse_route_sum", BOOK + " SELECT node, sum(loc)::DOUBLE AS x FROM book GROUP BY node")
def _(t: Tables):
    return P.reverse_route_sum(book(t).select("node", F.col("loc").cast("double").alias("x")))


@query("layer_route", BOOK + """, l AS (SELECT p.part, src AS node, ts, eid AS pos FROM e JOIN p ON p.node = dst UNION ALL SELECT p.part, dst, ts, eid FROM e JOIN p ON p.node = dst),
top AS (SELECT part, node, pos FROM (SELECT *, row_number() OVER (PARTITION BY part, node ORDER BY ts DESC, pos DESC) AS r FROM l) WHERE r = 1 AND node % 4 = part)
SELECT top.part, b.part AS target, row_number() OVER (PARTITION BY top.part ORDER BY b.part, top.node) - 1 AS ord, pos AS local_idx, loc AS remote_idx FROM top JOIN book b ON b.node = top.node AND b.part <> top.part""")
def _(t: Tables):
    e, p = graph(t)
    own = P.edge_owner(e, p)
    side = lambda c: own.select("part", F.col(c).alias("node"), "ts", F.col("eid").alias("pos"))
    return P.layer_route(side("src").unionByName(side("dst")), p, P.replicas(P.partition_book(e, p)))


@query("slot_route", BOOK + ", s AS (SELECT DISTINCT p.part, ts // 365 AS slot, unnest([src, dst]) AS node FROM e JOIN p ON p.node = dst) SELECT s.part, slot, b.part AS target, s.node, loc AS remote_idx FROM s JOIN book b ON b.node = s.node WHERE s.node % 4 = s.part AND b.part <> s.part")
def _(t: Tables):
    e, p = graph(t)
    return P.slot_route(P.edge_owner(e, p).withColumn("slot", F.expr("ts div 365")), p, P.replicas(P.partition_book(e, p)))


@query("label_lookup", EDGES + " SELECT eid, CASE WHEN ts < 2500 THEN label ELSE 1 END AS label FROM e")
def _(t: Tables):
    e = t.purchase_edges()
    known = e.filter("ts < 2500").select("eid", "label")
    return e.select("eid").join(known, "eid", "left").select("eid", F.coalesce("label", F.lit(1)).alias("label"))


@query("feature_gather", NODES + FEATS + WHOLE + " SELECT eid, md5(list_transform(x, lambda v: round(v * 1e6)::BIGINT)::VARCHAR) AS x_md5 FROM e JOIN fw ON node = src")
def _(t: Tables):
    e = t.purchase_edges()
    rows = e.select("eid", F.col("src").alias("node")).join(node_features(t, E.nodes(e), None), "node")
    return rows.select("eid", F.md5(F.transform("x", lambda v: F.round(v * 1e6).cast("long")).cast("string")).alias("x_md5"))


@query("state_read", NODES + FEATS + ", l AS (SELECT src AS node, max(ts) AS ts FROM e GROUP BY src) SELECT node, ts, x0, x1 FROM l JOIN ft USING (node)")
def _(t: Tables):
    e = t.purchase_edges()
    last = e.groupBy(F.col("src").alias("node")).agg(F.max("ts").alias("ts"))
    return last.join(node_features(t, E.nodes(e)), "node").select("node", "ts", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"))


@query("map_pairs", EDGES + ", u AS (SELECT src AS id, ts FROM e UNION SELECT dst, ts FROM e), k AS (SELECT id, ts, row_number() OVER (ORDER BY id, ts) - 1 AS i FROM u) SELECT eid, i AS local_id FROM e JOIN k ON id = src AND k.ts = e.ts")
def _(t: Tables):
    from ..operators.batch import merge_and_map

    e = t.purchase_edges()
    _pairs, mapped = merge_and_map(e.select(F.col("dst").alias("id"), "ts"), e.select(F.col("src").alias("id"), "ts", "eid"))
    return mapped.select("eid", "local_id")


@query("cross_part_ratio", NODES + " SELECT count(*) FILTER (src % 4 <> dst % 4) / count(*) AS ratio FROM e")
def _(t: Tables):
    e, p = graph(t)
    far = P.edge_owner(e, p).join(p.select(F.col("node").alias("src"), F.col("part").alias("owner")), "src")
    return far.agg((F.count_if(F.col("part") != F.col("owner")) / F.count("*")).alias("ratio"))


@query("load_imbalance", NODES + " SELECT round(stddev_pop(n) / avg(n), 9) AS imbalance FROM (SELECT part, count(*) AS n FROM e JOIN p ON p.node = dst GROUP BY part)")
def _(t: Tables):
    per = P.edge_owner(*graph(t)).groupBy("part").agg(F.count("*").alias("n"))
    return per.agg(F.round(F.stddev_pop("n") / F.avg("n"), 9).alias("imbalance"))


@query("partition_objective", NODES + " SELECT (SELECT count(*) FROM e WHERE src % 4 <> dst % 4) + 0.5::DOUBLE * (SELECT sum((c - m) * (c - m)) FROM (SELECT count(*) AS c, avg(count(*)) OVER () AS m FROM p GROUP BY part)) + 2.0::DOUBLE * (SELECT count(*) FROM p WHERE cluster % 4 <> (node // 3) % 4) AS objective")
def _(t: Tables):
    from ..operators import formulas as X

    e, p = graph(t)
    return X.partition_objective(e, p, p.select("node", F.pmod(F.expr("node div 3"), F.lit(4)).alias("part")), beta=0.5, eta=2.0)


@query("greedy_assign", NODES + ", c AS (SELECT src AS node, dst % 4 AS part, sum(w) AS near FROM e GROUP BY 1, 2), l AS (SELECT part, count(*) AS load FROM p GROUP BY part), s AS (SELECT DISTINCT src AS node FROM e), g AS (SELECT s.node, l.part, coalesce(near, 0) - 0.01::DOUBLE * load AS gain FROM s CROSS JOIN l LEFT JOIN c ON c.node = s.node AND c.part = l.part) SELECT node, part FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, part) AS r FROM g) WHERE r = 1")
def _(t: Tables):
    from ..operators import formulas as X

    e, p = graph(t)
    return X.greedy_assign(e, p, penalty=0.01)


_ = node_parts
