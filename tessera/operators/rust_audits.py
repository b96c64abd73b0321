"""Rust only: traits, unsafe code, unwraps, lint attributes and derives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.facts import Facts


def traits(facts: Facts) -> DataFrame:
    """In file and source order."""
    return facts.traits.orderBy("path", "ordinal").select("name", "file", "line", "visibility")


def unsafe_by_file(facts: Facts) -> DataFrame:
    """(file, unsafe_blocks, unsafe_functions) where there are any, most first; sizes of arrays, so no shuffle but the sort."""
    blocks = F.coalesce(F.try_element_at("counters", F.lit("unsafe_blocks")), F.lit(0)).cast("long")
    functions = F.size(F.filter("functions", lambda f: f["is_unsafe"])).cast("long")
    rows = facts.parsed.where("lang = 'rust'").select(F.col("display").alias("file"), blocks.alias("unsafe_blocks"), functions.alias("unsafe_functions"))
    return rows.where("unsafe_blocks + unsafe_functions > 0").orderBy(F.desc(F.col("unsafe_blocks") + F.col("unsafe_functions")), "file")


def unwrap_by_file(facts: Facts) -> DataFrame:
    return facts.counts("counters").where("key = 'unwrap_expect' AND n > 0").select("file", F.col("n").alias("count")).orderBy(F.desc("count"), "file")


def allow_lints(facts: Facts) -> DataFrame:
    return facts.counts("allow_lints").groupBy(F.col("key").alias("rule")).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "rule")


def derive_audit(facts: Facts) -> DataFrame:
    return facts.counts("derives").groupBy(F.col("key").alias("derive")).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "derive")
