"""Edge tables over the supplied star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edges import assign_position

#: Added to target ids, so that the two key ranges do not overlap.
DST_BASE = 1_000_000_000
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
PARTS = 4
CLUSTERS = 32


class Tables:
    """Lazily read tables of one folder, and the graphs made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._purchases: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def purchase_edges(self) -> DataFrame:
        """eid, src (customer), dst (part, shifted), ts (days since 1992), w (quantity), label (returned).

        Numbered and written once for all uses in a query.
        """
        if self._purchases is None:
            orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("src"))
            rows = self.table("lineitem").select(*LINE_KEY, F.col("l_quantity").alias("w"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
            rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
            kept = (
                "src",
                (F.col("l_partkey") + DST_BASE).alias("dst"),
                F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("ts"),
                "w",
                "label",
            )
            numbered = assign_position(rows, LINE_KEY, keep=kept, packed=True)
            self._purchases = numbered.select("eid", "src", "dst", "ts", "w", "label")
        return self._purchases

    def event_edges(self) -> DataFrame:
        """eid (event), src (user), dst (event type, numbered and shifted), ts (microseconds), w (value)."""
        events = self.table("events")
        kinds = assign_position(events.select("event_type").distinct(), ["event_type"], "_k")
        ts = F.unix_micros(F.col("ts").cast("timestamp"))
        return events.join(F.broadcast(kinds), "event_type").select(  # one row for each event type
            F.col("event_id").alias("eid"), F.col("user_id").alias("src"), (F.col("_k") + 1 + DST_BASE).alias("dst"), ts.alias("ts"), F.col("value").alias("w")
        )

    def asks(self) -> DataFrame:
        """roots(), repeated as often as they occur: samples count them once."""
        return self.purchase_edges().select(F.col("src").alias("node"), F.col("ts").alias("t"))

    def roots(self) -> DataFrame:
        """Every (source, its event time) of the purchase graph."""
        return self.asks().distinct()


def node_parts(nodes: DataFrame, parts: int = PARTS, clusters: int = CLUSTERS) -> DataFrame:
    """An assignment without a partitioner: by remainder of the id."""
    return nodes.select("node", F.pmod("node", F.lit(parts)).alias("part"), F.pmod("node", F.lit(clusters)).alias("cluster"))
