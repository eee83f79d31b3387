"""Per-node state: messages, mailboxes, memory, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from .edges import position_within


def mail_messages(events: DataFrame, memory: DataFrame) -> DataFrame:
    """events(batch, eid, src, dst, ts, feat), memory(node, h): the latest message of each node in each batch.

    The source gets [h_src, h_dst, feat], the target [h_dst, h_src, feat]; ties in ts go to the larger (eid, side).
    """
    side = lambda a, b, k: events.select("batch", "eid", "ts", F.lit(k).alias("side"), F.col(a).alias("node"), F.col(b).alias("other"))
    rows = side("src", "dst", 0).unionByName(side("dst", "src", 1))
    last = rows.groupBy("batch", "node").agg(F.max(F.struct("ts", "eid", "side", "other")).alias("m"))
    own = memory.select("node", F.col("h").alias("_own"))
    other = memory.select(F.col("node").alias("_o"), F.col("h").alias("_other"))
    feat = events.select(F.col("eid").alias("_e"), "feat")
    joined = last.join(own, "node").join(other, F.col("m.other") == F.col("_o")).join(feat, F.col("m.eid") == F.col("_e"))
    return joined.select("batch", "node", F.col("m.ts").alias("ts"), F.col("m.eid").alias("eid"), F.concat("_own", "_other", "feat").alias("mail"))


def mailbox(messages: DataFrame, size: int) -> DataFrame:
    """messages(node, ts, pos, mail): what a ring of `size` holds in the end; slot is the ring position."""
    placed = position_within(messages.select("node", "ts", "pos", "mail"), ["node"], ["ts", "pos"], "_i")
    sizes = placed.groupBy("node").agg(F.count("*").alias("_n"))
    return placed.join(sizes, "node").filter(F.col("_i") >= F.col("_n") - size).select("node", (F.col("_i") % size).alias("slot"), "ts", "pos", "mail")


def mailbox_reset(box: DataFrame) -> DataFrame:
    """Every slot kept, with a mail of zeros that came at time 0."""
    return box.withColumns({"mail": F.transform("mail", lambda x: F.lit(0.0)), "ts": F.lit(0).cast("long")})


def mailbox_read(nodes: DataFrame, box: DataFrame, size: int) -> DataFrame:
    """Every slot of every node asked for; empty slots are null."""
    grid = nodes.select("node").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return grid.join(box, ["node", "slot"], "left")


def memory_update(memory: DataFrame, mail: DataFrame, gates: V.Matrix, candidate: V.Matrix, te: int = 2) -> DataFrame:
    """memory(node, h, ts), mail(node, mail, ts): h' = GRU([mail, enc(mail_ts - ts)], h) and ts' = mail_ts where mail came."""
    m = mail.select("node", "mail", F.col("ts").alias("_t"))
    rows = memory.join(m, "node", "left")
    x = F.concat("mail", V.time_encode((F.col("_t") - F.col("ts")).cast("double"), te))
    new = V.gru_cell(x, F.col("h"), gates, candidate)
    return rows.select("node", F.when(F.col("mail").isNull(), F.col("h")).otherwise(new).alias("h"), F.coalesce("_t", "ts").alias("ts"))


def state_write(state: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(node, ...) replace those of state with the same node; rows of nodes that state lacks are not stored."""
    held = rows.join(state.select("node"), "node", "left_semi")
    return state.join(held.select("node"), "node", "left_anti").unionByName(held)


def stale_history_read(asks: DataFrame, history: DataFrame) -> DataFrame:
    """asks(node, t), history(node, ts, h): the last published state with ts <= t; nulls where there is none.

    As-of join by one sorted pass over the union; asks with equal (node, t) share their answer.
    """
    h = history.select("node", F.col("ts").alias("_x"), F.lit(0).alias("_o"), F.struct("ts", "h").alias("_s"), F.lit(None).cast("long").alias("t"))
    a = asks.select("node", F.col("t").alias("_x"), F.lit(1).alias("_o"), F.lit(None).cast(h.schema["_s"].dataType).alias("_s"), "t").distinct()
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy("node").orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, 0))
    return h.unionByName(a).withColumn("_l", last).filter("_o = 1").select("node", "t", F.col("_l.ts").alias("ts"), F.col("_l.h").alias("h"))


def compensate(h: Column, hist: Column, age: Column, is_remote: Column, w: V.Matrix, te: int = 2) -> Column:
    """Remote rows become ReLU([hist, enc(max(age, 0))] W), local rows stay."""
    x = F.concat(hist, V.time_encode(F.greatest(age, F.lit(0)).cast("double"), te))
    return F.when(is_remote, F.transform(V.linear(x, w), V.relu)).otherwise(h)


def compensate_flow(h: Column, velocity: Column, gate: Column) -> Column:
    return F.zip_with(h, velocity, lambda a, b: a + gate * b)


def epoch_reset(state: DataFrame) -> DataFrame:
    """All vectors zero, all times zero."""
    return state.withColumns({"h": F.transform("h", lambda x: F.lit(0.0)), "ts": F.lit(0).cast("long")})


def lstm_over_snapshots(rows: DataFrame, gates: V.Matrix, d: int) -> DataFrame:
    """rows(node, snap, x): h of each node after its snapshots in order; state flows from snapshot to snapshot.

    A fold over each node's own ordered snapshots: one array for each node, as long as there are snapshots.
    """
    seq = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("snap", "x"))).alias("s"))
    zero = F.array(*[F.lit(0.0)] * d)
    start = F.struct(zero.alias("h"), zero.alias("c"))

    step = lambda a, r: V.lstm_state(r["x"], a["h"], a["c"], gates)
    return seq.select("node", F.aggregate("s", start, step)["h"].alias("h"))
