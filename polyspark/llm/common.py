"""What several operators share: materialised steps in the shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that an operator may broadcast.
BROADCAST_LIMIT = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session (tests) that has none gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="polyspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_prefix(df: DataFrame) -> str:
    """A prefix for helper columns that no column of ``df`` has."""
    at = "__"
    while any(c.lower().startswith(at) for c in df.columns):
        at += "_"
    return at


def broadcast_value(spark: SparkSession, value, n_bytes: int):
    """Broadcast ``value`` after checking its size against ``BROADCAST_LIMIT``."""
    if n_bytes > BROADCAST_LIMIT:
        raise ValueError(f"{n_bytes} bytes are more than {BROADCAST_LIMIT} that may be broadcast")
    return spark.sparkContext.broadcast(value)


def partitions_for(rows: int, per_task: int, spark: SparkSession) -> int:
    """How many tasks ``rows`` need at ``per_task`` rows each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by repeated contraction.

    ``edges`` has long columns ``a`` and ``b`` (rows with nulls and loops are ignored). Returns
    ``(id, component)`` for every id in an edge, ``component`` the smallest id that it can reach.
    Each round points every node at the one of itself and its neighbours with the smallest hash, new in each round, and
    keeps only edges between different targets: whatever the order of ids, long paths shrink by a share.
    Rounds end when no edge is left. All steps are partial aggregations and equi-joins.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "cc-edges")
    out = edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("id"))
        hop = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), F.least(rank("a"), "m")["id"].alias("to"))
        hop = materialize(hop, "cc-hop")
        maps.append(hop)
        left = hop.select(F.col("id").alias("a"), F.col("to").alias("to_a"))
        right = hop.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        edges = edges.join(left, "a").join(right, "b").filter("to_a <> to_b")
        edges = materialize(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "cc-edges")
    if maps:
        out = maps[-1].select("id", F.col("to").alias("root"))
    for hop in reversed(maps[:-1]):
        later = out.select(F.col("id").alias("to"), "root")
        out = hop.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    # a target may have no edge of its own in any later round, so it stands for itself
    smallest = out.groupBy("root").agg(F.least(F.min("id"), F.first("root")).alias("component"))
    return out.join(smallest, "root").select("id", "component")
