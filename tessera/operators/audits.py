"""Frequencies of comments and literals that deserve a look, with the first places of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.facts import Facts

SAMPLES = 5


def _with_samples(counts: DataFrame, places: DataFrame, keys: list[str], order: list[str], shown) -> DataFrame:
    """Counts joined with the first ``SAMPLES`` places of each key; only those few rows are collected per key."""
    first = places.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= SAMPLES)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", shown.alias("shown")))).alias("s"))
    return counts.join(listed, keys, "left").withColumn("samples", F.coalesce(F.transform("s", lambda x: x["shown"]), F.array().cast("array<string>"))).drop("s")


def todo_audit(facts: Facts) -> DataFrame:
    """(lang, tag, count, samples[file:line])."""
    rows = facts.markers
    counts = rows.groupBy("lang", "tag").agg(F.count(F.lit(1)).alias("count"))
    shown = F.concat_ws(":", "file", F.col("line").cast("string"))
    return _with_samples(counts, rows, ["lang", "tag"], ["path", "line"], shown).orderBy(F.desc("count"), "tag")


def rule_audit(facts: Facts, family: str) -> DataFrame:
    """(rule, count, files): eslint rules that are switched off, or compiler directives."""
    rows = facts.rules.where(F.col("family") == family)
    counts = rows.groupBy("rule").agg(F.count(F.lit(1)).alias("count"))
    places = rows.select("rule", "path", "file").distinct()
    return _with_samples(counts, places, ["rule"], ["path"], F.col("file")).withColumnRenamed("samples", "files").orderBy(F.desc("count"), "rule")


def security_audit(facts: Facts) -> DataFrame:
    return facts.findings("secret").select("lang", "kind", "file", "line", "detail").orderBy("file", "line", "kind")
