"""What frameworks leave in code: decorators, routes, components, hooks, and the usual mistakes around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BoundaryRule
from ..plans.facts import Facts


def decorators(facts: Facts) -> DataFrame:
    """(decorator, count) over Python functions and classes; arguments are cut off."""
    each = lambda column: facts.parsed.where("lang = 'python'").select(F.explode(column).alias("r")).select(F.explode("r.decorators").alias("d"))
    name = F.ltrim(F.regexp_replace(F.substring_index("d", "(", 1), "^@+", ""))
    return each("functions").unionByName(each("types")).groupBy(name.alias("decorator")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "decorator")


def routes(facts: Facts) -> DataFrame:
    return facts.routes.select("method", F.col("path"), "handler", "file", "line", "dependencies").orderBy("path", "method")


def mutable_defaults(facts: Facts) -> DataFrame:
    """Shown with the absolute path."""
    rows = facts.findings("mutable_default")
    return rows.select(F.col("path").alias("file"), "line", F.col("name").alias("func_name"), F.col("detail").alias("param_name"), "kind").orderBy("file", "line")


def silent_handlers(facts: Facts) -> DataFrame:
    """Swallowed exceptions of Python and rejections and exceptions of scripts."""
    return facts.findings("silent").select("lang", "file", "line", "kind").orderBy("file", "line", "kind")


def console_debugger(facts: Facts) -> DataFrame:
    return facts.findings("console").select("file", "line", "kind").orderBy("file", "line")


def console_by_kind(facts: Facts) -> DataFrame:
    return facts.findings("console").groupBy("kind").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "kind")


def components(facts: Facts) -> DataFrame:
    return facts.functions.where("is_component").select("name", "file", "line", "props", "hooks", "path", "ordinal")


def component_props(facts: Facts) -> DataFrame:
    """Components with props, in file and source order."""
    return components(facts).where(F.size("props") > 0).orderBy("path", "ordinal").select("name", "file", "line", "props")


def custom_hooks(facts: Facts) -> DataFrame:
    """Exported functions named like hooks."""
    rows = facts.functions.where(F.col("exported") & F.col("name").rlike("^use[A-Z]"))
    return rows.select("name", F.col("line_count").alias("lines"), "file", "line").orderBy("name", "file", "line")


def hook_frequency(facts: Facts) -> DataFrame:
    """(hook, count, is_custom): components that use each hook."""
    used = components(facts).select(F.explode("hooks").alias("hook")).groupBy("hook").agg(F.count(F.lit(1)).alias("count"))
    own = custom_hooks(facts).select(F.col("name").alias("hook"), F.lit(True).alias("own")).distinct()
    return used.join(own, "hook", "left").select("hook", "count", F.coalesce("own", F.lit(False)).alias("is_custom")).orderBy(F.desc("count"), "hook")


def heavy_components(facts: Facts, least: int = 3) -> DataFrame:
    rows = components(facts).where(F.size("hooks") >= least)
    return rows.select("name", "file", "line", F.size("hooks").cast("long").alias("hook_count"), "hooks").orderBy(F.desc("hook_count"), "name", "file", "line")


def any_by_file(facts: Facts) -> DataFrame:
    return facts.counts("counters").where("key = 'any' AND n > 0").select("file", F.col("n").alias("count")).orderBy(F.desc("count"), "file")


def mobx_observer(facts: Facts) -> DataFrame:
    return facts.findings("mobx").select("file", "line", F.col("name").alias("component"), "kind").orderBy("file", "line")


def orm_case(facts: Facts) -> DataFrame:
    rows = facts.findings("orm")
    return rows.select("file", "line", F.col("name").alias("method"), F.col("detail").alias("snippet"), F.col("kind").alias("identifier"), "ordinal").orderBy("file", "line", "ordinal").drop("ordinal")


def boundary_violations(facts: Facts, rules: tuple[BoundaryRule, ...]) -> DataFrame:
    """One row per (rule, import, forbidden prefix); rules are a handful of command-line flags.

    Prefix tests against so few rules are a filtered explode of literals: no join, no shuffle of imports.
    The line is that of the file's last import of the same source.
    """
    pairs = [F.struct(F.lit(r.source).alias("source"), F.lit(p).alias("forbidden")) for r in rules for p in r.forbidden]
    wanted = F.array(*pairs) if pairs else F.array().cast("array<struct<source:string,forbidden:string>>")
    files = facts.parsed.where("lang = 'typescript'").select(F.col("display").alias("file"), "imports")
    rows = files.select("file", "imports", F.explode(F.filter(wanted, lambda r: F.startswith("file", r["source"]))).alias("r"))
    rows = rows.select("file", "imports", "r", F.explode("imports").alias("i")).where(F.startswith("i.source", "r.forbidden"))
    line = F.element_at(F.transform(F.filter("imports", lambda x: x["source"] == F.col("i.source")), lambda x: x["line"]), -1)
    return rows.select("file", line.alias("line"), F.col("i.source").alias("import_source"), F.concat_ws(" -> ", "r.source", "r.forbidden").alias("rule")).orderBy("file", "line")
