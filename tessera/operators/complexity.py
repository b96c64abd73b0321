"""Functions ranked by what makes them hard to follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.facts import Facts
from .inventory import ranked

_WHERE = ("name", "file", "line")


def complexity(facts: Facts, top: int | None = None) -> DataFrame:
    """Cyclomatic complexity, the other metrics beside it."""
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_test", "is_method", "is_component", "is_unsafe")]
    rows = facts.functions.select("lang", "name", F.col("complexity").alias("cc"), "cognitive", "params", "nesting", F.col("line_count").alias("lines"), "file", "line", *flags)
    return ranked(rows, F.desc("cc"), *map(F.asc, _WHERE), top=top)


def cognitive(facts: Facts, top: int | None = None) -> DataFrame:
    rows = facts.functions.select("lang", "name", "cognitive", "file", "line", F.coalesce("is_method", F.lit(False)).alias("is_method"), F.coalesce("is_component", F.lit(False)).alias("is_component"))
    return ranked(rows, F.desc("cognitive"), *map(F.asc, _WHERE), top=top)


def nesting(facts: Facts, top: int | None = None) -> DataFrame:
    """Only functions that nest at all."""
    rows = facts.functions.where("nesting > 0").select("lang", "name", F.col("nesting").alias("depth"), "file", "line", F.coalesce("is_method", F.lit(False)).alias("is_method"), F.coalesce("is_component", F.lit(False)).alias("is_component"))
    return ranked(rows, F.desc("depth"), *map(F.asc, _WHERE), top=top)
