"""Threshold gates: the first function, in report order, that breaches each limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Gates
from ..plans.facts import Facts
from . import graph

_SCHEMA = "gate string, value long, limit long, name string, file string, line long"


def breaches(facts: Facts, gates: Gates, n_cycles: int | None = None) -> DataFrame:
    """(gate, value, limit, name, file, line), at most one row a gate.

    Metric gates look in the order of the complexity report, the nesting gate in that of the nesting
    report.  Rust rows have no line counts there, so the lines gate never fires on them.  Each gate is
    a filter and a limit of one, which Spark runs as a top-1 per partition.
    """
    spark = facts.nested.sparkSession
    out = spark.createDataFrame([], _SCHEMA)
    functions = facts.functions
    by_complexity = [F.desc("complexity"), F.asc("name"), F.asc("file"), F.asc("line")]
    by_nesting = [F.desc("nesting"), F.asc("name"), F.asc("file"), F.asc("line")]
    for gate, column, limit, order in (
        ("max-complexity", "complexity", gates.max_complexity, by_complexity),
        ("max-cognitive-complexity", "cognitive", gates.max_cognitive, by_complexity),
        ("max-params", "params", gates.max_params, by_complexity),
        ("max-nesting", "nesting", gates.max_nesting, by_nesting),
        ("max-lines", "line_count", gates.max_lines, by_complexity),
    ):
        if limit is None:
            continue
        over = functions.where(F.col(column) > limit)
        if column == "line_count":
            over = over.where("lang <> 'rust'")
        first = over.orderBy(*order).limit(1)
        out = out.unionByName(first.select(F.lit(gate).alias("gate"), F.col(column).alias("value"), F.lit(limit).cast("long").alias("limit"), "name", "file", "line"))
    if gates.max_cycles is not None:
        n = graph.cycles(facts).count() if n_cycles is None else n_cycles
        if n > gates.max_cycles:
            out = out.unionByName(spark.createDataFrame([("max-cycles", n, gates.max_cycles, None, None, None)], _SCHEMA))
    return out
