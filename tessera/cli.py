"""Command line: scan a tree, print a report, and fail on breached gates.

Exit codes: 0 fine; 1 an error, a breached gate or a boundary violation; 2 a bad section or boundary.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from .config import LANGUAGES, BoundaryRule, Gates, ScanConfig
from .operators import gates as gate_operators
from .plans.facts import Facts, Settings, extract_facts
from .report import payload, text
from .sources import files

_SHOWN = {"python": "Python", "typescript": "TypeScript", "rust": "Rust"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Health report of a tree of Python, TypeScript and Rust source files")
    p.add_argument("path")
    for lang in LANGUAGES:
        p.add_argument(f"--{lang}", action="store_true")
    p.add_argument("--pkg")
    p.add_argument("--title")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--json", action="store_true")
    p.add_argument("--digest", action="store_true", help="a short Markdown digest instead of the text report")
    p.add_argument("--skip", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    for name in ("complexity", "cognitive-complexity", "params", "nesting", "cycles", "lines"):
        p.add_argument(f"--max-{name}", type=int)
    p.add_argument("--alias", default="@/")
    p.add_argument("--orm-check", default="")
    p.add_argument("--boundary", action="append", default=[])
    return p


def title_of(config: ScanConfig, languages: tuple[str, ...]) -> str:
    root = config.root.rstrip("/") if "://" in config.root else os.path.realpath(config.root)
    name = os.path.basename(root)
    label = os.path.basename(os.path.dirname(root)) or name if name in ("src", "lib") else name
    if len(languages) > 1:
        return f"{label.upper()} — AST ANALYSIS (multi-language)"
    shown = config.package if languages == ("python",) else label
    return f"{shown.upper()} — AST ANALYSIS ({_SHOWN[languages[0]]})"


def scan(spark: SparkSession, config: ScanConfig, languages: tuple[str, ...]) -> Facts:
    """Facts of a tree, parsed once and kept for all reports."""
    nested = extract_facts(files.source_rows(spark, config, languages), Settings(config.alias, config.orm_methods))
    return Facts(nested.persist(StorageLevel.MEMORY_AND_DISK))


def _message(row) -> str:
    if row["gate"] == "max-cycles":
        return f"{row['value']} cycles exceed --max-cycles {row['limit']}"
    return f"{row['value']} exceeds --{row['gate']} {row['limit']}: {row['name']} [{row['file']}:{row['line']}]"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    a = parser().parse_args(argv)
    try:
        boundaries = tuple(BoundaryRule.parse(b) for b in a.boundary)
    except ValueError as e:
        print(e, file=err)
        return 2
    g = Gates(a.max_complexity, a.max_cognitive_complexity, a.max_params, a.max_nesting, a.max_lines, a.max_cycles)
    if not files.is_directory(a.path):
        print(f"not a directory: {a.path}", file=err)
        return 1
    path = a.path if "://" in a.path else os.path.realpath(a.path)
    config = ScanConfig(path, package=a.pkg, alias=a.alias, exclude=tuple(a.exclude), orm_methods=tuple(m.strip() for m in a.orm_check.split(",") if m.strip()), boundaries=boundaries, top=a.top, skip=frozenset(a.skip), gates=g)
    try:
        languages = tuple(lang for lang in LANGUAGES if getattr(a, lang)) or files.detect_languages(path)
    except ValueError as e:
        print(e, file=err)
        return 1
    try:
        config.check_skip(languages)
    except ValueError as e:
        print(e, file=err)
        return 2
    own = spark is None
    spark = spark or SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").getOrCreate()
    facts = scan(spark, config, languages)
    try:
        documents = {lang: payload.LanguageReport(facts, lang, config).payload() for lang in languages}
        title = a.title or title_of(config, languages)
        # scripts that don't parse leave no trace in reports, so each is named here
        for row in facts.nested.where("lang = 'typescript' AND parse_error IS NOT NULL").select("display", "parse_error").orderBy("display").toLocalIterator():
            print(f"  SKIP: {row['display']}: {row['parse_error']}", file=err)
        if a.json:
            print(payload.to_json(documents, title), file=out)
            return 0
        failed = False
        for lang, doc in documents.items():
            own_title = title if len(documents) == 1 else a.title or title_of(config, (lang,))
            print(text.digest(doc, own_title) if a.digest else text.render(doc, own_title, a.top, config.skip), file=out)
            report = Facts(facts.nested.where(facts.nested["lang"] == lang))
            for row in gate_operators.breaches(report, g, n_cycles=len(doc["cycles"])).collect():
                print(f"THRESHOLD BREACH: {_message(row)}", file=err)
                failed = True
            check = doc.get("import_boundaries")
            if check and check["violations"] and "import-boundaries" not in config.skip:
                print(f"BOUNDARY VIOLATIONS: {len(check['violations'])}", file=err)
                failed = True
        return int(failed)
    finally:
        facts.nested.unpersist()
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
