"""Owners, partition books, halos, replicas, packed ids, permutations and clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import edges as E

PART_SHIFT, PART_BITS, SHARED_BIT = 48, 14, 62
LOC_MASK = (1 << PART_SHIFT) - 1


def pack_dist_id(part: Column, loc: Column, shared: Column | None = None) -> Column:
    """Bits 0 to 47 the local index, 48 to 61 the part, 62 the shared flag."""
    packed = F.shiftleft(part.cast("long"), PART_SHIFT).bitwiseOR(loc.cast("long"))
    return packed if shared is None else packed.bitwiseOR(F.when(shared, F.lit(1 << SHARED_BIT)).otherwise(F.lit(0).cast("long")))


def unpack_dist_id(packed: Column) -> tuple[Column, Column, Column]:
    part = F.shiftright(packed, PART_SHIFT).bitwiseAND((1 << PART_BITS) - 1)
    return part, packed.bitwiseAND(LOC_MASK), F.shiftright(packed, SHARED_BIT).bitwiseAND(1) == 1


def pack_chunk(part: Column, chunk: Column) -> Column:
    return F.shiftleft(part.cast("int"), 16).bitwiseOR(chunk.cast("int"))


def edge_owner(edges: DataFrame, parts: DataFrame, by: str = "dst") -> DataFrame:
    return edges.join(parts.select(F.col("node").alias(by), "part"), by)


def halo_nodes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """part, node, owner: distinct sources of edges that a part owns (by target) and that another part owns."""
    owner = parts.select(F.col("node").alias("src"), F.col("part").alias("owner"))
    return edge_owner(edges, parts).join(owner, "src").filter("part <> owner").select("part", F.col("src").alias("node"), "owner").distinct()


def outer_nodes(edges: DataFrame, parts: DataFrame, shared: DataFrame) -> DataFrame:
    """Batch form, edges owned by source: per part the targets that it neither owns nor has as shared copies."""
    mine = edge_owner(edges, parts, "src").select("part", F.col("dst").alias("node")).distinct()
    return mine.join(parts.select("part", "node"), ["part", "node"], "left_anti").join(shared.select("node"), "node", "left_anti").select("part", "node")


def partition_book(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """part, loc, node, is_owned: per part its own nodes in order, then its halo in order."""
    both = parts.select("part", "node", F.lit(True).alias("is_owned")).unionByName(halo_nodes(edges, parts).select("part", "node", F.lit(False).alias("is_owned")))
    placed = E.position_within(both.withColumn("_h", ~F.col("is_owned")), ["part"], ["_h", "node"], "loc")
    return placed.select("part", "node", "is_owned", "loc")


def replicas(book: DataFrame) -> DataFrame:
    """node, rank, loc for every stored copy, the owner's included."""
    return book.select("node", F.col("part").alias("rank"), "loc")


def replica_lookup(batch: DataFrame, copies: DataFrame) -> DataFrame:
    """batch(pos, node): every copy of every batch node."""
    return batch.join(copies, "node")


def g2l_lookup(ids: DataFrame, book: DataFrame, part: int | None = None) -> DataFrame:
    """part, node, loc: the local index of each node in a part, or in every part, -1 where it is not stored."""
    parts = book.select("part").distinct() if part is None else book.sparkSession.createDataFrame([(part,)], "part long")
    asked = ids.select("node").crossJoin(F.broadcast(parts))  # parts are few
    return asked.join(book.select("part", "node", "loc"), ["part", "node"], "left").withColumn("loc", F.coalesce("loc", F.lit(-1)).cast("long"))


def residence(book: DataFrame) -> DataFrame:
    """is_master, is_remote, is_stored by local index and the number of own nodes."""
    masters = book.filter("is_owned").groupBy("part").agg(F.count("*").alias("_m"))
    rows = book.join(F.broadcast(masters), "part", "left")  # a row for each part
    m = F.coalesce(F.col("_m"), F.lit(0))
    return rows.select("part", "node", "loc", ((F.col("loc") >= 0) & (F.col("loc") < m)).alias("is_master"), (F.col("loc") >= m).alias("is_remote"), (F.col("loc") >= 0).alias("is_stored"))


def layer_route(nodes: DataFrame, parts: DataFrame, copies: DataFrame) -> DataFrame:
    """nodes(part, node, ts, pos) of a layer: for the latest row of each node that the part owns, the other copies.

    Columns part, target, ord, local_idx (pos of that row), remote_idx (loc at the target).
    """
    top = nodes.groupBy("part", "node").agg(F.max(F.struct("ts", "pos")).alias("top"))
    own = top.join(parts.select("node", F.col("part").alias("owner")), "node").filter("part = owner")
    rows = own.join(copies, "node").filter("rank <> part")
    rows = rows.select("part", F.col("rank").alias("target"), "node", F.col("top.pos").alias("local_idx"), F.col("loc").alias("remote_idx"))
    return E.position_within(rows, ["part"], ["target", "node"], "ord").select("part", "target", "ord", "local_idx", "remote_idx")


def slot_route(edges: DataFrame, parts: DataFrame, copies: DataFrame, keep_self: bool = False) -> DataFrame:
    """Per (part, slot): distinct ends that the part owns, to each of their copies."""
    ends = edges.select("part", "slot", F.col("src").alias("node")).unionByName(edges.select("part", "slot", F.col("dst").alias("node"))).distinct()
    own = ends.join(parts.select("node", F.col("part").alias("owner")), "node").filter("part = owner")
    rows = own.join(copies, "node")
    return (rows if keep_self else rows.filter("rank <> part")).select("part", "slot", F.col("rank").alias("target"), "node", F.col("loc").alias("remote_idx"))


def send_lists(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """sender, receiver, node, ord: what each part receives for its halo, seen from the sender; ordered by node."""
    halo = halo_nodes(edges, parts).select(F.col("owner").alias("sender"), F.col("part").alias("receiver"), "node")
    return E.position_within(halo, ["sender", "receiver"], ["node"], "ord")


def halo_fetch(features: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Per part: the rows of its own nodes, then those received for its halo. features(node, x)."""
    own = parts.join(features, "node").select("part", "node", "x", F.lit(True).alias("is_owned"))
    return own.unionByName(halo_nodes(edges, parts).select("part", "node").join(features, "node").select("part", "node", "x", F.lit(False).alias("is_owned")))


def reverse_route_sum(rows: DataFrame) -> DataFrame:
    """Adjoint of halo_fetch: values of all copies added onto their owner. rows(node, x)."""
    return rows.groupBy("node").agg(F.sum("x").alias("x"))


def hot_replication(parts: DataFrame, hot: DataFrame) -> DataFrame:
    """part, loc, node, is_shared: hot nodes first in every part, then the part's other nodes."""
    every = F.broadcast(parts.select("part").distinct())  # parts are few
    shared = hot.select("node").crossJoin(every).withColumn("_c", F.lit(0))
    rest = parts.select("node", "part").join(hot.select("node"), "node", "left_anti").withColumn("_c", F.lit(1))
    placed = E.position_within(shared.unionByName(rest), ["part"], ["_c", "node"], "loc")
    return placed.select("part", "loc", "node", (F.col("_c") == 0).alias("is_shared"))


def reorder_perm(parts: DataFrame) -> DataFrame:
    """parts(node, part, is_hot, in_deg, avg_ts): new_id, node. Per part the hot nodes by falling in-degree, then the
    others by time bucket and id; nodes without a part come last."""
    from .windows import time_buckets

    cold = time_buckets(parts.filter("NOT is_hot AND part IS NOT NULL")).select("node", "part", F.lit(1).alias("_c"), "bucket", F.lit(0).cast("long").alias("_k"))
    hot = parts.filter("is_hot AND part IS NOT NULL").select("node", "part", F.lit(0).alias("_c"), F.lit(0).cast("long").alias("bucket"), (-F.col("in_deg")).alias("_k"))
    lost = parts.filter("part IS NULL").select("node", F.lit(1 << 40).alias("part"), F.lit(2).alias("_c"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("_k"))
    return E.assign_position(hot.unionByName(cold).unionByName(lost), ["part", "_c", "bucket", "_k", "node"], "new_id").select("new_id", "node")


def apply_perm(edges: DataFrame, perm: DataFrame) -> DataFrame:
    pick = lambda side: perm.select(F.col("node").alias(side), F.col("new_id").alias(f"new_{side}"))
    return edges.join(pick("src"), "src").join(pick("dst"), "dst").drop("src", "dst").withColumnsRenamed({"new_src": "src", "new_dst": "dst"})


def _moves_of_a_round(adjacent: DataFrame, label: DataFrame, total: float, resolution: float, step: int) -> DataFrame:
    """label(node, c, k) after one round: half of the nodes, by hash, may move to the neighbouring cluster of most gain."""
    load = label.groupBy("c").agg(F.sum("k").alias("_t"))
    near = adjacent.filter("a <> b").join(label.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), F.col("c").alias("_c")).agg(F.sum("w").alias("_w"))
    asks = near.join(label.filter(F.pmod(F.xxhash64(F.lit(step), "node"), F.lit(2)) == 0), "node").join(load.withColumnRenamed("c", "_c"), "_c")
    own = F.col("c") == F.col("_c")
    gain = resolution * F.col("_w") - F.col("k") * (F.col("_t") - F.when(own, F.col("k")).otherwise(0.0)) / total
    best = asks.withColumn("_g", F.round(gain, 9)).groupBy("node").agg(F.max(F.when(own, F.col("_g"))).alias("_own"), F.min(F.when(~own, F.struct((-F.col("_g")).alias("g"), "_c"))).alias("_b"))
    # Without a neighbour in its own cluster a node gains by staying only what the cluster's load costs it, at most nothing.
    moves = best.filter("_b IS NOT NULL AND -_b.g > coalesce(_own, 0.0)").select("node", F.col("_b._c").alias("_to"))
    return cut_lineage(label.join(moves, "node", "left").select("node", F.coalesce("_to", "c").alias("c"), "k"))


def modularity_clusters(edges: DataFrame, resolution: float = 3.0, rounds: int = 4, levels: int = 2) -> DataFrame:
    """node, cluster: local moves by modularity gain, then the same on the graph of the clusters, `levels` times.

    A node's gain in a cluster is resolution times its edges there less the product of both degrees over all edges, so
    a higher resolution gives larger clusters. All nodes of a round move at once; half of them may, so that neighbours
    do not swap for ever. A cluster's name is one of its nodes. Parallel edges count once, self loops not.
    """
    adjacent = cut_lineage(E.bidirect(edges.filter("src <> dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w")))
    total = adjacent.agg(F.sum("w")).first()[0] or 1.0
    found = None
    for level in range(levels):
        label = cut_lineage(adjacent.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("c"), "k"))
        for i in range(rounds):
            label = _moves_of_a_round(adjacent, label, total, resolution, level * rounds + i)
        named = label.select("node", "c")
        found = named if found is None else found.withColumnRenamed("c", "_n").join(named.select(F.col("node").alias("_n"), "c"), "_n").select("node", "c")
        side = lambda end: named.select(F.col("node").alias(end), F.col("c").alias(f"_{end}"))
        adjacent = cut_lineage(adjacent.join(side("a"), "a").join(side("b"), "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")))
    return found.select("node", F.col("c").alias("cluster"))


def balanced_partition(edges: DataFrame, k: int, *, groups: DataFrame | None = None, by_edges: bool = True, rounds: int = 2, resolution: float = 3.0) -> DataFrame:
    """node, group, part: k parts of nearly equal load with few edges between them; loads are degrees, or nodes.

    Starts from clusters laid end to end and cut into k equal loads. In each round nodes wish for the part that holds
    most of their neighbours, and for every two parts as much load as wishes to go each way is exchanged, dearest wishes
    first: loads differ by a few nodes at most, whatever the graph. groups(node, group): parts are made in each group,
    and only edges inside a group count; nodes without such edges have load 1.
    """
    nodes = E.nodes(edges).withColumn("group", F.lit(0).cast("long")) if groups is None else groups.select("node", F.col("group").cast("long"))
    nodes = cut_lineage(nodes)
    home = lambda end: nodes.select(F.col("node").alias(end), F.col("group").alias(f"_{end}"))
    inner = edges.select("src", "dst").filter("src <> dst").join(home("src"), "src").join(home("dst"), "dst").filter("_src = _dst").select("src", "dst")
    both = cut_lineage(inner.union(inner.select("dst", "src")).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count("*").alias("w")))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"))
    load = F.coalesce("d", F.lit(1)) if by_edges else F.lit(1)
    clusters = modularity_clusters(both.select(F.col("a").alias("src"), F.col("b").alias("dst")), resolution, rounds=5, levels=2)
    rows = nodes.join(degree, "node", "left").join(clusters, "node", "left").select("node", "group", load.cast("long").alias("load"), F.coalesce("cluster", "node").alias("_c"))
    placed = E.running_within(rows, ["group"], ["_c", "node"], "load", "_upto")
    sums = rows.groupBy("group").agg(F.sum("load").alias("_all"))
    middle = (F.col("_upto") * 2 - F.col("load")) * k / (F.col("_all") * 2)
    part = cut_lineage(placed.join(sums, "group").select("node", "group", "load", F.least(F.floor(middle), F.lit(k - 1)).alias("part")))
    for i in range(rounds):
        near = both.join(part.select(F.col("node").alias("b"), F.col("part").alias("_p")), "b").groupBy(F.col("a").alias("node"), "_p").agg(F.sum("w").alias("_w"))
        asks = near.join(part.filter(F.pmod(F.xxhash64(F.lit(i), "node"), F.lit(2)) == 0), "node")
        own = F.col("_p") == F.col("part")
        best = asks.groupBy("node", "group", "part", "load").agg(F.coalesce(F.max(F.when(own, F.col("_w"))), F.lit(0)).alias("_own"), F.min(F.when(~own, F.struct((-F.col("_w")).alias("w"), "_p"))).alias("_b"))
        wish = cut_lineage(best.filter("-_b.w > _own").select("node", "group", "part", "load", F.col("_b._p").alias("_to"), (F.col("_b.w") + F.col("_own")).alias("_cost")))
        if wish.isEmpty():
            break
        ways = wish.groupBy("group", "part", "_to").agg(F.sum("load").alias("_l"))  # k * k rows a group
        back = ways.select("group", F.col("part").alias("_to"), F.col("_to").alias("part"), F.col("_l").alias("_back"))
        quota = ways.join(back, ["group", "part", "_to"]).select("group", "part", "_to", F.least("_l", "_back").alias("_q"))
        go = E.running_within(wish, ["group", "part", "_to"], ["_cost", "node"], "load", "_upto").join(quota, ["group", "part", "_to"]).filter("_upto <= _q").select("node", "_to")
        part = cut_lineage(part.join(go, "node", "left").select("node", "group", "load", F.coalesce("_to", "part").alias("part")))
    return part.select("node", "group", "part")


def singleton_clusters(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nodes without a cluster get new ids behind the largest, by node."""
    top = clusters.agg(F.max("cluster")).first()[0]
    lone = E.assign_position(nodes.select("node").join(clusters, "node", "left_anti"), ["node"], "_i")
    return clusters.select("node", "cluster").unionByName(lone.select("node", (F.col("_i") + ((-1 if top is None else top) + 1)).alias("cluster")))


#: Nodes of a bucket that one task orders; larger buckets are ordered piece by piece.
MAX_BUCKET = 100_000


def rcm_order(edges: DataFrame, buckets: DataFrame, limit: int = MAX_BUCKET) -> DataFrame:
    """buckets(node, part, bucket): per bucket a reverse Cuthill-McKee order of its nodes: part, bucket, node, ord.

    Degrees count all neighbours, those outside the bucket (its halo) as well; the walk goes from member to member,
    since nothing is known of a halo node's own edges. A breadth-first walk is sequential, so each bucket, or each
    `limit` nodes of one by id, is a grouped task.
    """
    import pandas as pd

    b = E.position_within(buckets.select("node", "part", "bucket"), ["part", "bucket"], ["node"], "_i").withColumn("_piece", F.floor(F.col("_i") / limit)).drop("_i")
    b = cut_lineage(b)
    both = cut_lineage(E.bidirect(edges.filter("src <> dst")))
    home = F.struct("part", "bucket", "_piece")
    placed = both.join(b.select(F.col("node").alias("src"), home.alias("_s")), "src").join(b.select(F.col("node").alias("dst"), home.alias("_d")), "dst")
    near = placed.filter("_s = _d").groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("near"))  # members of one piece
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    rows = b.join(near, "node", "left").join(degree, "node", "left").select("part", "bucket", "_piece", "node", "near", F.coalesce("deg", F.lit(0)).alias("deg"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        adjacent = {n: [] if x is None else list(x) for n, x in zip(frame["node"], frame["near"], strict=True)}
        size = dict(zip(frame["node"], frame["deg"], strict=True))
        rank = lambda n: (size[n], n)
        order, seen = [], set()
        for start in sorted(adjacent, key=rank):
            if start in seen:
                continue
            seen.add(start)
            queue = [start]
            for n in queue:
                for m in sorted((m for m in adjacent[n] if m not in seen), key=rank):
                    seen.add(m)
                    queue.append(m)
            order += queue
        order.reverse()
        first = int(frame["_piece"].iloc[0]) * limit
        return pd.DataFrame({"part": frame["part"].iloc[0], "bucket": frame["bucket"].iloc[0], "node": order, "ord": range(first, first + len(order))})

    return rows.groupBy("part", "bucket", "_piece").applyInPandas(walk, "part long, bucket long, node long, ord long")
