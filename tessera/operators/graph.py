"""The import graph: degrees, coupling and cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.facts import Facts
from .components import connected, discard, written

#: Edges up to which cycles are searched on the driver; larger graphs are searched by component.
DRIVER_EDGES = 200_000


def _module_of(path: str):
    """A resolved script path as a module id: no extension, no trailing /index."""
    return F.regexp_replace(F.regexp_replace(path, r"\.(?:tsx|ts|jsx|js)$", ""), r"/index$", "")


def import_records(facts: Facts) -> DataFrame:
    """(lang, src, dst, names): every internal import, repeats included."""
    rows = facts.imports.where("is_internal AND (lang <> 'rust' OR target <> '')")
    dst = F.when(F.col("lang") == "typescript", _module_of("target")).otherwise(F.col("target"))
    src = F.col("module")
    return rows.select("lang", src.alias("src"), dst.alias("dst"), F.col("specifiers").alias("names"))


def edges(facts: Facts) -> DataFrame:
    """Distinct (lang, src, dst)."""
    return import_records(facts).select("lang", "src", "dst").distinct()


def modules(facts: Facts) -> DataFrame:
    """(lang, module) of every scanned file that parses."""
    return facts.parsed.select("lang", "module").distinct()


def top_imported(facts: Facts, top: int | None = None) -> DataFrame:
    """Import records by target, also of targets outside the tree."""
    counts = import_records(facts).groupBy("lang", F.col("dst").alias("module")).agg(F.count(F.lit(1)).alias("count"))
    out = counts.orderBy(F.desc("count"), "module")
    return out if top is None else out.limit(top)


def graph_size(facts: Facts) -> DataFrame:
    """(lang, modules, edges)."""
    m = modules(facts).groupBy("lang").agg(F.count(F.lit(1)).alias("modules"))
    e = edges(facts).groupBy("lang").agg(F.count(F.lit(1)).alias("edges"))
    return m.join(e, "lang", "left").select("lang", "modules", F.coalesce("edges", F.lit(0)).alias("edges"))


def external_packages(facts: Facts, top: int | None = None) -> DataFrame:
    """Imports from outside, by package (scripts) or crate (Rust)."""
    rows = facts.imports.where(~F.col("is_internal") & F.col("lang").isin("typescript", "rust"))
    parts = F.split("import_source", "/")
    script = F.when(F.col("import_source").startswith("@") & (F.size(parts) > 1), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])
    name = F.when(F.col("lang") == "typescript", script).otherwise(F.substring_index("import_source", "::", 1))
    counts = rows.select("lang", name.alias("package")).where("package <> ''").groupBy("lang", "package").agg(F.count(F.lit(1)).alias("count"))
    out = counts.orderBy(F.desc("count"), "package")
    return out if top is None else out.limit(top)


def coupling(facts: Facts) -> DataFrame:
    """(lang, module, ca, ce, instability) of scanned modules that import or are imported.

    One shuffle of the distinct edges, seen from both ends, pre-aggregated before it.
    """
    e = edges(facts)
    ends = e.select("lang", F.col("src").alias("module"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select("lang", F.col("dst").alias("module"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degrees = ends.groupBy("lang", "module").agg(F.sum("into").alias("ca"), F.sum("out").alias("ce"))
    scanned = degrees.join(modules(facts), ["lang", "module"], "left_semi")
    ratio = F.round(F.col("ce") / (F.col("ca") + F.col("ce")) * 100) / 100
    return scanned.select("lang", "module", "ca", "ce", ratio.alias("instability")).orderBy(F.desc(F.col("ca") + F.col("ce")), "module")


def search_cycles(adjacent: dict[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """Depth-first search from every node in order; each edge back into the current path is a cycle.

    (root, number, path with its first node repeated); a finished node is never entered again, so
    this is not every elementary cycle.  Iterative, so that long chains are no problem.
    """
    done: set[str] = set()
    found = []
    for root in sorted(adjacent):
        if root in done:
            continue
        path, place = [root], {root: 0}
        todo = [iter(sorted(adjacent.get(root, ())))]
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                node = path.pop()
                del place[node]
                done.add(node)
            elif step in place:
                found.append((root, len(found), [*path[place[step] :], step]))
            elif step not in done:
                place[step] = len(path)
                path.append(step)
                todo.append(iter(sorted(adjacent.get(step, ()))))
    return found


def _unique(cycles: list[tuple[str, int, list[str]]]) -> list[tuple[str, int, list[str]]]:
    """The first cycle over each set of nodes."""
    seen: set[frozenset[str]] = set()
    return [c for c in cycles if not (frozenset(c[2]) in seen or seen.add(frozenset(c[2])))]


def _cycles_of(pairs) -> list[tuple[str, int, list[str]]]:
    adjacent: dict[str, list[str]] = {}
    for src, dst in pairs:
        adjacent.setdefault(src, []).append(dst)
    return _unique(search_cycles(adjacent))


def _without_sinks(e: DataFrame, rounds: int = 10) -> DataFrame:
    """Edges without those to modules that import nothing, again and again: no search through them meets a cycle.

    Modules that nothing imports stay, for a search may begin with one and so decide how a cycle is written.
    """
    path, left = None, None
    for _ in range(rounds):
        open_ends = e.select("lang", F.col("src").alias("dst")).distinct()
        after, after_path = written(e.join(open_ends, ["lang", "dst"], "left_semi"), "edges")
        if path:
            discard(e.sparkSession, path)
        e, path, before, left = after, after_path, left, after.count()
        if left == before:
            break
    return e


def cycles(facts: Facts, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(lang, ordinal, nodes, text): import cycles in search order.

    Nodes of one weakly connected component never meet another's search, so a graph beyond
    ``driver_edges`` is split by component and searched in parallel; a smaller one is searched on
    the driver, its size having been counted.
    """
    e = edges(facts)
    spark = e.sparkSession
    limited = e.limit(driver_edges + 1).collect()
    if len(limited) <= driver_edges:
        rows = []
        for lang in sorted({r["lang"] for r in limited}):
            found = _cycles_of((r["src"], r["dst"]) for r in limited if r["lang"] == lang)
            rows += [(lang, k, nodes) for k, (_, _, nodes) in enumerate(found)]
        out = spark.createDataFrame(rows, "lang string, ordinal long, nodes array<string>")
    else:
        # names of one language start with its tag, so that languages never share a component
        tag = lambda c: F.concat("lang", F.lit("\x00"), c)
        e = _without_sinks(e)
        roots = connected(e.select(tag("src").alias("a"), tag("dst").alias("b")))
        grouped = e.withColumn("node", tag("src")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

        def search(group: pd.DataFrame) -> pd.DataFrame:
            found = _cycles_of(zip(group["src"], group["dst"]))
            return pd.DataFrame([(group["lang"].iloc[0], root, k, nodes) for root, k, nodes in found], columns=["lang", "first", "k", "nodes"])

        found = grouped.groupBy("lang", "root").applyInPandas(search, "lang string, first string, k long, nodes array<string>")
        order = W.partitionBy("lang").orderBy("first", "k")
        out = found.withColumn("ordinal", F.row_number().over(order).cast("long") - 1).select("lang", "ordinal", "nodes")
    return out.withColumn("text", F.concat_ws(" -> ", "nodes"))
