"""Sizes: summaries, the split of test and production code, and ranked inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.facts import Facts


def _total(condition: Column, value: Column | None = None) -> Column:
    """Sum of ``value`` (or count of rows) where ``condition`` holds; 0 for no rows."""
    value = F.lit(1) if value is None else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")


def _share(part: Column, rest: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), (part + rest).cast("double")), F.lit(0.0))


def summary(facts: Facts) -> DataFrame:
    """One row per language: counts of files, lines, functions, types, imports and errors.

    All of it comes from array sizes of the nested rows, in one aggregation without an explode.
    Rust counts only files that parse; Python counts every file, but lines only of those that parse.
    """
    f = facts.files
    parsed = F.col("parse_error").isNull()
    functions = F.col("functions")
    per_file = f.select(
        "lang",
        parsed.alias("parsed"),
        "line_count",
        F.size("functions").alias("n_functions"),
        F.size("types").alias("n_types"),
        F.size("traits").alias("n_traits"),
        F.size(F.filter("imports", lambda i: i["is_internal"])).alias("internal"),
        F.size(F.filter("imports", lambda i: ~i["is_internal"])).alias("external"),
        F.size(F.filter(functions, lambda x: F.coalesce(x["is_component"], F.lit(False)))).alias("components"),
        F.size(F.filter(functions, lambda x: F.coalesce(x["exported"], F.lit(False)) & x["name"].rlike("^use[A-Z]"))).alias("custom_hooks"),
        ((F.col("lang") != "rust") | parsed).alias("counted"),
    )
    n = lambda c: F.sum(c).cast("long")
    return per_file.groupBy("lang").agg(
        _total(F.col("counted")).alias("files"),
        _total(F.col("parsed")).alias("files_parsed"),
        _total(~F.col("parsed")).alias("parse_errors"),
        _total(F.col("parsed"), F.col("line_count")).alias("lines"),
        n("n_functions").alias("functions"),
        n("n_types").alias("classes"),
        n("n_traits").alias("traits"),
        n("internal").alias("internal_imports"),
        n("external").alias("external_imports"),
        n("components").alias("components"),
        n("custom_hooks").alias("custom_hooks"),
    )


def test_prod(facts: Facts) -> DataFrame:
    """Lines and functions of test and of production files that parse, by language.

    Python methods count as functions and again as members of their class.
    """
    members = F.aggregate("types", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(t["methods"], F.lit(0)))
    n = F.size("functions") + F.when(F.col("lang") == "python", members).otherwise(0)
    per_file = facts.parsed.select("lang", "is_test", "line_count", n.alias("n"))
    test = F.col("is_test")
    sums = per_file.groupBy("lang").agg(
        _total(test, F.col("line_count")).alias("test_lines"),
        _total(~test, F.col("line_count")).alias("production_lines"),
        _total(test, F.col("n")).alias("test_functions"),
        _total(~test, F.col("n")).alias("production_functions"),
    )
    return sums.withColumn("line_ratio_test", _share(F.col("test_lines"), F.col("production_lines"))).withColumn("function_ratio_test", _share(F.col("test_functions"), F.col("production_functions")))


def ranked(df: DataFrame, *order: Column, top: int | None = None) -> DataFrame:
    """``df`` in a total order; with ``top``, Spark keeps only the k best rows of each partition."""
    out = df.orderBy(*order)
    return out if top is None else out.limit(top)


def files_by_lines(facts: Facts, top: int | None = None) -> DataFrame:
    rows = facts.parsed.select("lang", F.col("display").alias("file"), F.col("line_count").alias("lines"))
    return ranked(rows, F.desc("lines"), F.asc("file"), top=top)


def largest_functions(facts: Facts, top: int | None = None) -> DataFrame:
    rows = facts.functions.select("lang", "name", F.col("line_count").alias("lines"), "file", "line", F.coalesce("is_method", F.lit(False)).alias("is_method"), F.coalesce("is_component", F.lit(False)).alias("is_component"))
    return ranked(rows, F.desc("lines"), F.asc("name"), F.asc("file"), F.asc("line"), top=top)


def largest_types(facts: Facts, top: int | None = None) -> DataFrame:
    """Classes (Python, TypeScript), structs and enums (Rust)."""
    rows = facts.types.select("lang", "name", "kind", F.col("line_count").alias("lines"), "methods", "properties", "fields", F.coalesce("has_heritage", F.lit(False)).alias("has_heritage"), "file", "line")
    return ranked(rows, F.desc("lines"), F.asc("name"), F.asc("file"), F.asc("line"), top=top)


def parse_errors(facts: Facts) -> DataFrame:
    rows = facts.files.where(F.col("parse_error").isNotNull()).select("lang", F.col("display").alias("file"), F.col("parse_error").alias("message"))
    return rows.orderBy("file", "message")
