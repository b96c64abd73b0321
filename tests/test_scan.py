"""Scanning real trees: listing, reading, reports, gates and exit codes."""

import io
import json

import pytest

from tessera.cli import main
from tessera.config import BoundaryRule, ScanConfig
from tessera.operators import graph
from tessera.plans.facts import Facts, extract_facts
from tessera.report import payload
from tessera.sources import files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj") / "shop"
    (root / "store").mkdir(parents=True)
    (root / "basket.py").write_text("def fill(rows=[], prices={}, sold=set()):\n    rows.append(prices)\n    return rows, sold\n")
    (root / "till.py").write_text("from store.tax import *\n")
    (root / "store" / "__init__.py").write_text('"""What is in stock."""\n')
    (root / "store" / "tax.py").write_text('"""Rates."""\n\n\ndef rate(goods, land):\n    if goods or land:\n        return 7\n    return 19\n')
    return root


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    root = tmp_path_factory.mktemp("mixed") / "app"
    (root / "web").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "node_modules" / "x" / "i.ts").write_text("export const no = 1;\n")
    (root / "web" / "a.ts").write_text("import { b } from './b';\nimport r from 'react';\nexport function greet(name) {\n  if (name) { return b; }\n  return r;\n}\n")
    (root / "web" / "b.ts").write_text("import { greet } from './a';\nexport const b = greet;\n")
    (root / "web" / "bad.ts").write_text("function (\n")
    (root / "lib.rs").write_text("pub fn f(a: bool) -> u8 {\n    if a { 1 } else { 2 }\n}\n")
    (root / "bad.rs").write_text("fn f( {\n")
    (root / "m.py").write_text("# TODO: one\nx = 1\n")
    (root / "latin.py").write_bytes(b"x = '\xe9'\n")
    return root


def run(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    code = main([str(a) for a in argv], spark=spark, out=out, err=err)
    return code, out.getvalue(), err.getvalue()


def test_python_payload(spark, tree):
    code, out, _ = run(spark, tree, "--python", "--pkg", "store", "--json")
    doc = json.loads(out)
    assert code == 0
    s = doc["summary"]
    assert (s["files"], s["files_parsed"], s["parse_errors"], s["lines"], s["functions"], s["classes"], s["internal_imports"]) == (4, 4, 0, 16, 2, 0, 1)
    assert s["test_prod"] == {"test_lines": 0, "production_lines": 16, "test_functions": 0, "production_functions": 2, "line_ratio_test": 0.0, "function_ratio_test": 0.0}
    rate = doc["complexity"][0]
    assert tuple(rate[k] for k in ("name", "cc", "cognitive", "params", "nesting", "lines", "line", "file")) == ("rate", 3, 1, 2, 1, 4, 4, "shop/store/tax.py")
    assert doc["imports"] == {"modules": 4, "edges": 1, "top_imported": [{"module": "store.tax", "count": 1}]}
    assert doc["coupling"] == [{"module": "store.till", "ca": 0, "ce": 1, "instability": 1.0}]
    assert doc["cycles"] == [] and doc["code_clones"] == []
    assert [(d["module"], d["name"]) for d in doc["dead_exports"]] == [("store.basket", "fill"), ("store.store.tax", "rate")]
    assert [(m["param_name"], m["kind"], m["line"]) for m in doc["mutable_defaults"]] == [("rows", "list", 1), ("prices", "dict", 1), ("sold", "call", 1)]
    assert all(m["file"].startswith("/") for m in doc["mutable_defaults"])


def test_text_report_and_skip(spark, tree):
    code, out, err = run(spark, tree, "--python", "--skip", "coupling")
    assert code == 0 and "END OF REPORT" in out and "MODULE COUPLING" not in out and "CYCLOMATIC" in out and not err
    code, _, err = run(spark, tree, "--python", "--skip", "nope")
    assert code == 2 and "nope" in err
    code, out, _ = run(spark, tree, "--python", "--digest")
    assert code == 0 and out.startswith("# ")


@pytest.mark.parametrize(("flags", "code"), [(["--max-complexity", 1], 1), (["--max-lines", 1], 1), (["--max-nesting", 50, "--max-cycles", 0], 0), (["--max-params", 2], 1), (["--max-cognitive-complexity", 1], 0)])
def test_gates(spark, tree, flags, code):
    got, _, err = run(spark, tree, "--python", *flags)
    assert got == code and ("BREACH" in err) == bool(code)


def test_exclude(spark, tree):
    doc = json.loads(run(spark, tree, "--python", "--exclude", "tax.py", "--json")[1])
    assert doc["summary"]["files"] == 3


def test_multi_language(spark, mixed):
    assert files.detect_languages(str(mixed)) == ("python", "typescript", "rust")
    code, out, err = run(spark, mixed, "--json")
    doc = json.loads(out)
    assert [line.split(":")[:2] for line in err.splitlines()] == [["  SKIP", " app/web/bad.ts"]]
    assert code == 0 and "multi-language" in doc["report_title"]
    assert doc["typescript"]["summary"]["files"] == 2
    assert doc["typescript"]["cycles"] == ["web/a -> web/b -> web/a"]
    assert doc["typescript"]["orm_case_check"] is None and doc["typescript"]["import_boundaries"] is None
    assert doc["rust"]["summary"]["files"] == 1 and [e["file"] for e in doc["rust"]["parse_errors"]] == ["bad.rs"]
    assert "type1_clones" not in doc["rust"] and "lines" not in doc["rust"]["complexity"][0]
    assert doc["python"]["summary"]["files"] == 2 and doc["python"]["todo_audit"]["total"] == 1
    assert "scan_root" in doc["python"]
    assert run(spark, mixed)[1].count("END OF REPORT") == 3


def test_trees_in_stores(spark, mixed):
    """A URI gives the report of the path, however many parts the listing has."""
    one, two = (json.loads(run(spark, where, "--json")[1]) for where in (mixed, f"file://{mixed}"))
    for doc in (one, two):
        for lang in files.LANGUAGES:
            del doc[lang]["scan_root"]
    assert one == two
    at = files.store(str(mixed))
    for enough in (1, 2, 50):
        heads = files._heads(*at, files.LIST_PRUNED, enough)
        found = [p for top, deep in heads for p in ((p for p, _ in files.walk(at[0], top, files.LIST_PRUNED)) if deep else (f"{top}/{n}" for n, directory, _ in files._entries(at[0], top) if not directory))]
        assert sorted(found) == sorted(p for p, _ in files.walk(*at, files.LIST_PRUNED)) and len(found) == 7


def test_boundaries(spark, mixed):
    code, out, err = run(spark, mixed, "--typescript", "--boundary", "app/web:react,./b")
    assert code == 1 and "BOUNDARY VIOLATIONS: 2" in err and "app/web -> react" in out
    assert run(spark, mixed, "--typescript", "--boundary", "app/web:react", "--skip", "import-boundaries")[0] == 0
    assert run(spark, mixed, "--boundary", "nonsense")[0] == 2


def test_empty_tree(spark, tmp_path):
    assert run(spark, tmp_path)[0] == 1
    code, out, _ = run(spark, tmp_path, "--rust", "--json")
    assert code == 0 and json.loads(out)["summary"]["files"] == 0
    assert run(spark, tmp_path / "missing")[0] == 1


def test_partitioning_does_not_change_results(spark, mixed):
    config = ScanConfig(str(mixed))
    rows = files.source_rows(spark, config, ("typescript", "rust"))
    one, many = (sorted(map(str, extract_facts(rows.repartition(n)).collect())) for n in (1, 8))
    assert one == many


def test_sections_as_tables(spark, mixed, tmp_path):
    config = ScanConfig(str(mixed), boundaries=(BoundaryRule("app", ("react",)),))
    facts = Facts(extract_facts(files.source_rows(spark, config, ("typescript",))).cache())
    payload.write_sections(payload.LanguageReport(facts, "typescript", config), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/typescript/complexity")).count() == 1
    facts.register("t_")
    assert spark.sql("SELECT count(*) FROM t_functions").first()[0] == 1


@pytest.mark.parametrize(("edges", "cycles"), [([("a", "b"), ("b", "c"), ("c", "a")], [["a", "b", "c", "a"]]), ([("a", "b"), ("b", "c")], []), ([("a", "a")], [["a", "a"]]), ([("a", "b"), ("b", "a"), ("c", "b")], [["a", "b", "a"]])])
def test_cycle_search(edges, cycles):
    assert [c[2] for c in graph._cycles_of(edges)] == cycles


def test_distributed_cycles_equal_driver_cycles(spark):
    import random

    rng = random.Random(3)
    edges = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(45)}
    rows = [("python", "/p", a, a, 1, False, None, [], [], [], [{"source": a, "target": b, "specifiers": [], "is_internal": True, "line": 1}], [], [], [], [], {}, {}, {}, [], []) for a, b in sorted(edges)]
    from tessera.plans.schema import FACTS

    facts = Facts(spark.createDataFrame(rows, FACTS))
    here, there = ([r["text"] for r in graph.cycles(facts, n).orderBy("ordinal").collect()] for n in (10_000, 1))
    assert here == there and here
