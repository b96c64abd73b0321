"""A corpus of source files rendered from tables, with facts that are arithmetic on their keys.

Every row of ``part`` becomes a Python file, of ``customer`` a TypeScript file, of ``supplier`` a
Rust file.  Rendering is Catalyst string functions only, so files are produced where they are parsed
and nothing is written or collected.  The truth of every report over this corpus is plain SQL on the
tables, independent of any parser: see :mod:`tessera.registry`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import SOURCE

#: Directory of the file of key k, and the key that file k imports from: blocks of ten, each with one cycle.
PY_DIR = "CASE WHEN {k} % 6 = 0 THEN 'tests' ELSE 'm' || CAST({k} % 7 AS STRING) END"
TARGET = "({k} - {k} % 10 + (({k} % 10) * ({k} % 10) + 1) % 10)"

# The files, line by line: (condition on k or TRUE, SQL string expression).  ``n`` is the depth of
# nested ifs, ``b`` how many of them test two operands.
PYTHON_LINES = [
    ("TRUE", "'import os'"),
    ("TRUE", "'from corpus.' || {target_dir} || '.part_' || {target} || ' import run_' || {target}"),
    ("TRUE", "CASE WHEN k % 4 = 0 THEN '# ' || element_at(array('TODO', 'FIXME', 'HACK', 'XXX'), CAST(k div 4 % 4 AS INT) + 1) || ' look at ' || k ELSE '# nothing to do' END"),
    ("TRUE", "'limit = ' || k"),
    ("k % 11 = 0", "'token = \"ghp_' || repeat('a', 36) || '\"'"),
    ("TRUE", "CASE WHEN k % 8 = 0 THEN '@router.' || element_at(array('get', 'post', 'put', 'delete', 'patch'), CAST(k % 5 AS INT) + 1) || '(\"/part/' || k || '\")' ELSE '@cached' END"),
    ("TRUE", "'def run_' || k || '(a, b=' || CASE WHEN k % 10 = 0 THEN '[]' ELSE 'None' END || '):'"),
    ("n > 0", "array_join(transform(sequence(1, n), i -> repeat('    ', CAST(i AS INT)) || CASE WHEN i <= b THEN 'if a and b:' ELSE 'if a:' END), '\n')"),
    ("TRUE", "repeat('    ', n + 1) || 'pass'"),
    ("pad > 0", "array_join(transform(sequence(1, pad), i -> '    x = a'), '\n')"),
    ("TRUE", "'    return a'"),
    ("k % 5 = 0", "'class Box_' || k || ':\n    def size(self):\n        return 1'"),
    ("k % 9 = 0", "'try:\n    run_' || k || '(1)\nexcept Exception:\n    pass'"),
    ("k % 13 = 0", "'def shared_helper(x):\n' || repeat('    x = x + 1\n', 10) || '    return x'"),
]

TYPESCRIPT_LINES = [
    ("TRUE", "'import { useThing } from \"@/hooks/use_thing\";'"),
    ("TRUE", "'import { fn_' || {target} || ' } from \"../c' || ({target} % 5) || '/item_' || {target} || '\";'"),
    ("TRUE", "'import lib from \"' || element_at(array('lodash/get', '@scope/pkg/sub', 'react'), CAST(k % 3 AS INT) + 1) || '\";'"),
    ("TRUE", "CASE WHEN k % 4 = 3 THEN 'import { observer } from \"mobx-react-lite\";' ELSE '// no store' END"),
    ("TRUE", "CASE WHEN k % 6 = 0 THEN '// eslint-disable-next-line no-console, no-alert' WHEN k % 6 = 3 THEN '// @ts-ignore' ELSE '// note' END"),
    ("TRUE", "'export function fn_' || k || '(a: ' || CASE WHEN k % 7 = 0 THEN 'any' ELSE 'number' END || ', b: number) {'"),
    ("n > 0", "array_join(transform(sequence(1, n), i -> repeat('  ', CAST(i AS INT)) || CASE WHEN i <= b THEN 'if (a && b) {' ELSE 'if (a) {' END), '\n')"),
    ("TRUE", "'  console.' || CASE WHEN k % 2 = 0 THEN 'log' ELSE 'warn' END || '(a);'"),
    ("n > 0", "repeat('}', n)"),
    ("TRUE", "'  return a;\n}'"),
    ("k % 2 = 1", "'export const Card_' || k || ' = ({ title, size: width }: Props) => {\n  const [s] = useState(0);\n  useEffect(() => {}, []);' || CASE WHEN k % 3 = 1 THEN '\n  useMemo(() => s);' ELSE '' END || CASE WHEN k % 3 = 2 THEN '\n  useOwn_' || (k % 4) || '();' ELSE '' END || '\n  return <div>{title}</div>;\n};'"),
    ("k % 10 = 1", "'export function useThing() { return 1; }'"),
    ("k % 8 = 0", "'work().catch(() => {});'"),
    ("k % 8 = 1", "'try { fn_' || k || '(1, 2); } catch {}'"),
    ("k % 9 = 0", "'db.query(\"select t.userName from t\");'"),
    ("k % 12 = 0", "'debugger;'"),
]

RUST_LINES = [
    ("TRUE", "'use crate::s' || ({target} % 3) || '::item_' || {target} || '::run_' || {target} || ';'"),
    ("TRUE", "CASE WHEN k % 2 = 0 THEN 'use serde::Serialize;' ELSE 'use std::fmt::{self, Display};' END"),
    ("TRUE", "'#[allow(dead_code)]\n#[derive(Debug, Clone' || CASE WHEN k % 3 = 0 THEN ', serde::Serialize' ELSE '' END || ')]\npub struct Rec_' || k || ' {\n    pub a: u32,\n    b: Vec<u32>,\n}'"),
    ("k % 4 = 0", "'pub trait Show_' || k || ' {\n    fn show(&self) -> u32 { 1 }\n}'"),
    ("TRUE", "'impl Rec_' || k || ' {\n    pub fn get(&self, x: u32) -> u32 {\n        self.a + x\n    }\n}'"),
    ("TRUE", "'pub ' || CASE WHEN k % 10 = 3 THEN 'unsafe ' ELSE '' END || 'fn run_' || k || '(a: bool, b: bool) -> u32 {'"),
    ("n > 0", "array_join(transform(sequence(1, n), i -> repeat('    ', CAST(i AS INT)) || CASE WHEN i <= b THEN 'if a && b {' ELSE 'if a {' END), '\n')"),
    ("n > 0", "repeat('}', n)"),
    ("k % 5 = 0", "'    let v = maybe().unwrap();'"),
    ("k % 6 = 0", "'    unsafe { touch(); }'"),
    ("k % 7 = 0", "'    // TODO: finish ' || k"),
    ("TRUE", "'    1\n}'"),
]


# A second corpus, of a row of ``supplier`` a file, with the forms that the first one lacks: relative,
# star and namespace imports, methods and decorators with arguments, classes with heritage, hooks of
# one's own, enums, paths by self and super, and long functions of few shapes.
PYTHON_FORMS = [
    ("TRUE", "'from .form_' || {target} || ' import size as s' || (k % 3)"),
    ("TRUE", "'from ..util_' || (k % 2) || ' import *'"),
    ("TRUE", "'from ...top import thing, other as o'"),
    ("TRUE", "'class Box_' || k || ':\n    @cached(ttl=' || (k % 4) || ')\n    def size(self, a):\n        return a'"),
    ("k % 3 = 0", "'    async def pull(self, a, b=1):\n        return a'"),
]
TYPESCRIPT_FORMS = [
    ("TRUE", "'export * from \"./form_' || {target} || '\";'"),
    ("TRUE", "'import * as util from \"../d' || ({target} % 3) || '/form_' || {target} || '\";'"),
    ("TRUE", "'export class Box_' || k || CASE WHEN k % 2 = 0 THEN ' extends Base' ELSE '' END || ' {\n  private name: string = \"x\";\n  get size() { return 1; }\n  run(this: Box, a: number, ...rest: number[]) { return a; }\n}'"),
    ("TRUE", "'export function useOwn_' || (k % 4) || '() { return 1; }'"),
    ("TRUE", "'export const Card_' || k || ' = () => {\n  useOwn_' || (k % 4) || '();\n  return <div/>;\n};'"),
    ("TRUE", "'export function long_' || k || '(a: number) {\n' || repeat('  let x = a;\n', 9) || repeat('  if (a) {\n', CAST(k % 3 AS INT)) || '  work(a);\n' || repeat('  }\n', CAST(k % 3 AS INT)) || '  return a;\n}'"),
]
RUST_FORMS = [
    ("TRUE", "'use self::inner::one;'"),
    ("TRUE", "'use super::form_' || {target} || '::long_' || {target} || ';'"),
    ("TRUE", "'use super::super::top;'"),
    ("TRUE", "'pub enum Kind_' || k || ' {\n    A,\n    B(u32),\n' || CASE WHEN k % 2 = 0 THEN '    C { x: u8 },\n' ELSE '' END || '}'"),
    ("TRUE", "'pub fn long_' || k || '(a: bool) -> u32 {\n' || repeat('    touch();\n', 9) || repeat('    if a {\n', CAST(k % 3 AS INT)) || '    work();\n' || repeat('    }\n', CAST(k % 3 AS INT)) || '    1\n}'"),
]


def _render(lines: list[tuple[str, str]]) -> str:
    """SQL of a file's text: lines whose condition holds, joined, with a line end after the last."""
    target = TARGET.format(k="k")
    values = {"target": f"CAST({target} AS STRING)", "target_dir": f"({PY_DIR.format(k=target)})"}
    parts = ", ".join(f"CASE WHEN {cond} THEN {expr} END" for cond, expr in lines)
    for name, value in values.items():
        parts = parts.replace("{" + name + "}", value)
    return f"concat_ws('\n', {parts}) || '\n'"


def _sources(base: DataFrame, lang: str, below: str, root: str, lines: list[tuple[str, str]]) -> DataFrame:
    rows = base.withColumn("below", F.expr(below)).withColumn("source", F.expr(_render(lines)))
    display = F.col("below") if lang == "rust" else F.concat(F.lit(root + "/"), "below")
    return rows.select(F.lit(lang).alias("lang"), F.concat(F.lit("/src/"), display).alias("path"), display.alias("display"), "below", F.lit(root).alias("package"), "source")


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "CAST(p_size % 6 AS INT) AS n", "CAST(least(p_size % 3, p_size % 6) AS INT) AS b", "CAST(p_size % 2 * 10 AS INT) AS pad")
    return _sources(part, "python", f"{PY_DIR.format(k='k')} || '/part_' || k || '.py'", "corpus", PYTHON_LINES)


def typescript_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS k", "CAST(c_custkey % 5 AS INT) AS n", "CAST(least(c_custkey % 3, c_custkey % 5) AS INT) AS b")
    return _sources(rows, "typescript", "'c' || (k % 5) || '/item_' || k || CASE WHEN k % 2 = 1 THEN '.tsx' ELSE '.ts' END", "web", TYPESCRIPT_LINES)


def rust_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k", "CAST(s_suppkey % 5 AS INT) AS n", "CAST(least(s_suppkey % 3, s_suppkey % 5) AS INT) AS b")
    return _sources(rows, "rust", "'s' || (k % 3) || '/item_' || k || '.rs'", "crate", RUST_LINES)


def _forms(lang: str, suffix: str, root: str, top: str, lines: list[tuple[str, str]]):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k")
        return _sources(rows, lang, f"'{top}d' || (k % 3) || '/form_' || k || '{suffix}'", root, lines)

    return build


BUILDERS = {"python": python_sources, "typescript": typescript_sources, "rust": rust_sources}
FORMS = {
    "python_forms": _forms("python", ".py", "forms", "lib/", PYTHON_FORMS),
    "typescript_forms": _forms("typescript", ".tsx", "forms", "", TYPESCRIPT_FORMS),
    "rust_forms": _forms("rust", ".rs", "crate", "", RUST_FORMS),
}


def sources(spark: SparkSession, sf_dir: str, *languages: str) -> DataFrame:
    """SOURCE rows of the corpora of ``languages`` (those of the first corpus by default), spread evenly over the cluster's cores.

    Generated files are tiny rows of a small table: a scan alone would parse them in very few tasks.
    """
    out = None
    for lang in languages or BUILDERS:
        rows = (BUILDERS | FORMS)[lang](spark, sf_dir)
        out = rows if out is None else out.unionByName(rows)
    return out.select(*SOURCE.names).repartition(max(2, 2 * spark.sparkContext.defaultParallelism))
