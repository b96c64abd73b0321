"""Groups of functions with one structure, or one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.facts import Facts

#: Functions up to this many lines are too short to be clones.
MIN_LINES = 10


def clone_members(facts: Facts, exact: bool = False) -> DataFrame:
    """(lang, hash, count, name, file, line, lines): every member of every group of two or more.

    A window count keeps members as rows, so a group of any size is never one value.
    """
    column = "exact_hash" if exact else "clone_hash"
    rows = facts.functions.where((F.col("line_count") > MIN_LINES) & F.col(column).isNotNull())
    if exact:
        rows = rows.where("lang <> 'rust'")
    rows = rows.select("lang", F.col(column).alias("hash"), "name", "file", "line", F.col("line_count").alias("lines"), "path", "ordinal")
    sizes = rows.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    return rows.join(sizes, ["lang", "hash"]).select("lang", "hash", "count", "name", "file", "line", "lines", "path", "ordinal")


def clone_groups(facts: Facts, exact: bool = False, members: int | None = None) -> DataFrame:
    """(lang, hash, count, functions[name, file, line, lines]), largest first; ``members`` bounds the list, not the count."""
    rows = clone_members(facts, exact)
    if members is not None:
        rows = rows.withColumn("k", F.row_number().over(W.partitionBy("lang", "hash").orderBy("path", "ordinal"))).where(F.col("k") <= members)
    member = F.struct("path", "ordinal", "name", "file", "line", "lines")
    grouped = rows.groupBy("lang", "hash", "count").agg(F.array_sort(F.collect_list(member)).alias("m"))
    functions = F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["file"].alias("file"), x["line"].alias("line"), x["lines"].alias("lines")))
    return grouped.select("lang", "hash", "count", functions.alias("functions")).orderBy(F.desc("count"), "hash")
