"""Connected components of an undirected graph, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if df was counted to hold at most max_rows; else Spark plans a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Hooks that are followed before the result is written.
JUMPS = 3


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset a local master gets a temporary folder; a cluster gets an error, since a
    machine-local folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Each round every node hooks to its smallest neighbour (or stays a root), hooks are followed, several
    at a time, until all point to roots, and the graph shrinks to its roots. The rounds
    are logarithmic, and what the driver sees of each is one count. A node with many edges costs
    a row a task in the minimum, and joins with roots can be split. Null ends are dropped.
    """
    ends = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    cur = stored(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.inline(ends)).distinct(), "edges")
    labels: DataFrame | None = None
    while True:
        up = stored(cur.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "hooks")
        while True:
            above, jumped = up.select(F.col("a").alias("up"), F.col("up").alias("top")), up
            for _ in range(JUMPS):
                jumped = jumped.join(above, "up").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            up = stored(jumped, "hooks")
            if not up.filter("moved").limit(1).count():
                break
        up = up.select("a", "up")
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            moved = up.select(F.col("a").alias("component"), F.col("up").alias("to"))
            labels = stored(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        left = cur.join(up, "a").select(F.col("up").alias("x"), "b")
        left = left.join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b").filter("x <> y")
        cur = stored(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if not cur.limit(1).count():
            return labels
