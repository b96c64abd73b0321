"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else the warehouse; a local master, one machine, has a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and (context.master == "local" or context.master.startswith("local[")):
        named = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Delete what :func:`written` wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, reread, and its path: lineage ends where lost executors cannot reach it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the component's smallest node.

    Alternating contraction: every node sends its larger neighbours to its smallest one, then its
    smaller neighbours and itself.  Each round is two aggregations and joins on node columns; rows
    never exceed the edges.  Rounds are logarithmic in practice.
    """
    now, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        outward = both.where("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = outward.groupBy("a").agg(F.min("b").alias("m"))
        moved = outward.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, after_path = written(low.select("a", F.col("m").alias("b")).unionByName(moved).where("a <> b").distinct(), "components")
        settled = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        discard(edges.sparkSession, path)
        now, path = after, after_path
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
