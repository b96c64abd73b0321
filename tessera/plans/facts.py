"""Source rows to facts: the one step that leaves the JVM.

``extract_facts`` maps each file to one nested row (Arrow batches in and out, no shuffle); everything
after it is relational.  Files are independent, so partitions are only for parallelism.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import python_source, rust_source, script_source, text_audits
from .schema import FACTS, SOURCE

#: Facts rows in one output batch, at most.
BATCH = 256


@dataclass(frozen=True)
class Settings:
    """What extraction itself depends on."""

    alias: str = "@/"
    orm_methods: tuple[str, ...] = ()


def file_facts(row: dict, settings: Settings = Settings()) -> dict:
    """Facts of one source row, as a dict with the fields of FACTS."""
    lang, display, below = row["lang"], row["display"], row["below"]
    source = row["source"]
    if lang == "python":
        source = (source or "").replace("\r", "")
        module = python_source.module_id(below, row["package"])
        facts = python_source.extract(source, display, module, row["package"])
    elif lang == "typescript":
        module = script_source.module_id(below)
        facts = script_source.extract(source, display, below, settings.alias, settings.orm_methods)
    else:
        source = source.replace("\r", "")
        module = rust_source.module_id(display)
        facts = rust_source.extract(source, display)
    facts |= {"lang": lang, "path": row["path"], "display": display, "module": module}
    parsed = facts["parse_error"] is None
    facts["markers"] = text_audits.markers(source) if parsed else []
    facts["rules"] = text_audits.suppressions(source) if parsed and lang == "typescript" else []
    facts["counters"], facts["allow_lints"], facts["derives"] = (list(facts[k].items()) for k in ("counters", "allow_lints", "derives"))
    return facts


def extract_facts(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One FACTS row per row of ``sources``; unreadable scripts and Rust files (null source) are dropped, Python ones are empty."""
    schema = to_arrow_schema(FACTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for start in range(0, len(rows), BATCH):
                made = [file_facts(r, settings) for r in rows[start : start + BATCH] if r["source"] is not None or r["lang"] == "python"]
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    return sources.select(*SOURCE.names).mapInArrow(run, FACTS)


class Facts:
    """Fact tables over nested facts; each is a projection, evaluated only where used."""

    def __init__(self, nested: DataFrame):
        self.nested = nested
        #: What reports count: scripts that fail to parse leave no trace, Rust and Python ones keep their error.
        self.files = nested.where((F.col("lang") != "typescript") | F.col("parse_error").isNull())
        self.parsed = nested.where(F.col("parse_error").isNull())

    def table(self, column: str) -> DataFrame:
        """An array of structs as rows, with the file's lang, display, module and the element's position."""
        rows = self.parsed.select("lang", "path", F.col("display").alias("file"), "module", F.posexplode(column).alias("ordinal", "row"))
        return rows.select("lang", "path", "file", "module", "ordinal", "row.*")

    @property
    def functions(self) -> DataFrame:
        return self.table("functions")

    @property
    def types(self) -> DataFrame:
        return self.table("types")

    @property
    def traits(self) -> DataFrame:
        return self.table("traits")

    @property
    def routes(self) -> DataFrame:
        rows = self.parsed.select("lang", F.col("display").alias("file"), "module", F.posexplode("routes").alias("ordinal", "row"))
        return rows.select("lang", "file", "module", "ordinal", "row.*")

    @property
    def imports(self) -> DataFrame:
        return self.table("imports").withColumnRenamed("source", "import_source")

    @property
    def markers(self) -> DataFrame:
        return self.table("markers")

    @property
    def rules(self) -> DataFrame:
        return self.table("rules")

    def findings(self, family: str) -> DataFrame:
        return self.table("findings").where(F.col("family") == family).drop("family")

    @property
    def exports(self) -> DataFrame:
        rows = self.parsed.select("lang", F.col("display").alias("file"), "module", F.posexplode("exports").alias("ordinal", "name"))
        return rows

    @property
    def star_sources(self) -> DataFrame:
        return self.parsed.select("lang", "module", F.explode("star_sources").alias("target"))

    def counts(self, column: str) -> DataFrame:
        """A map of counts as (lang, file, key, n)."""
        return self.parsed.select("lang", F.col("display").alias("file"), F.explode(column).alias("key", "n"))

    def register(self, prefix: str = "") -> None:
        """Temporary views of all fact tables, so that they can be queried in SQL."""
        for name in ("files", "functions", "types", "traits", "routes", "imports", "markers", "rules", "exports", "star_sources"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        for family in ("silent", "console", "mobx", "orm", "secret", "mutable_default"):
            self.findings(family).createOrReplaceTempView(f"{prefix}{family}_findings")
