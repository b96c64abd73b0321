"""Exports that nothing imports by name, as anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.facts import Facts
from .graph import _module_of, import_records


def dead_exports(facts: Facts) -> DataFrame:
    """(lang, module, name), repeated where a name is exported repeatedly.

    A module is left out if everything is taken from it (star imports and re-exports), or if it is an
    entry point by name.  Rust names are looked up by their last segment and shown in full.
    """
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]+$", "")
    lang, name = F.col("lang"), F.col("name")
    kept = facts.exports.where(
        (lang == "python") & ~name.startswith("_")
        | (lang == "typescript") & ~name.startswith("_") & ~stem.isin("App", "main") & ~F.col("file").rlike(r"/index\.(?:tsx?|jsx?)$")
        | (lang == "rust") & (name != "*") & ~F.substring_index("name", "::", -1).startswith("_") & ~stem.isin("main", "lib", "mod")
    )
    stars = facts.star_sources.select("lang", F.when(lang == "typescript", _module_of("target")).otherwise(F.col("target")).alias("module")).distinct()
    used = import_records(facts).select("lang", F.col("dst").alias("module"), F.explode("names").alias("used")).distinct()
    # Rust imports of an item are recorded under the item's own path, which is then the looked-up module
    open_ = kept.join(stars, ["lang", "module"], "left_anti").withColumn("used", F.when(lang == "rust", F.substring_index("name", "::", -1)).otherwise(name))
    return open_.join(used, ["lang", "module", "used"], "left_anti").select("lang", "module", "name").orderBy("module", "name")
