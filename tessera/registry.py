"""All queries over source code and tables, by name, and the SQL that checks them."""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BoundaryRule, Gates
from .operators import audits, clones, complexity, exports, frameworks, gates, graph, inventory, rust_audits, tables
from .plans.facts import Facts, Settings, extract_facts
from .sources import corpus

#: Nested facts that stay cached: parsing dominates, and reports share it.
_CACHED: OrderedDict[tuple, Facts] = OrderedDict()
KEEP = 8
BOUNDARIES = (BoundaryRule("web/c1", ("../c2", "react")), BoundaryRule("web/c", ("@scope",)))


def facts_of(spark: SparkSession, sf_dir: str, *languages: str) -> Facts:
    """Facts of the corpora of ``languages`` at ``sf_dir``, parsed once while cached."""
    key = (spark.sparkContext.applicationId, sf_dir, languages)
    if key in _CACHED:
        _CACHED.move_to_end(key)
        return _CACHED[key]
    if len(languages) > 1:
        # several languages are those of each, parsed once
        parts = [facts_of(spark, sf_dir, lang).nested for lang in languages]
        return Facts(reduce(DataFrame.unionByName, parts))
    nested = extract_facts(corpus.sources(spark, sf_dir, *languages), Settings(orm_methods=("query",)))
    _CACHED[key] = Facts(nested.persist(StorageLevel.MEMORY_AND_DISK))
    while len(_CACHED) > KEEP:
        _, old = _CACHED.popitem(last=False)
        if old.nested.sparkSession.sparkContext.applicationId == spark.sparkContext.applicationId:
            old.nested.unpersist()
    return _CACHED[key]


def _query(languages: tuple[str, ...], build):
    return lambda spark, sf_dir: build(facts_of(spark, sf_dir, *languages))


PY, TS, RS = ("python",), ("typescript",), ("rust",)
PY_FORMS, TS_FORMS, RS_FORMS = ("python_forms",), ("typescript_forms",), ("rust_forms",)
ALL = ("python", "typescript", "rust")


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, so that results compare by value."""
    for c in columns:
        df = df.withColumn(c, F.array_join(c, ","))
    return df


def _clones(f: Facts, exact: bool) -> DataFrame:
    """Group sizes with the first and last member's name: hashes themselves are ids without meaning."""
    rows = clones.clone_members(f, exact)
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("count"), F.min("name").alias("first_name"), F.max("name").alias("last_name"), F.sum("lines").alias("total_lines")).drop("hash")


def _cycles(f: Facts) -> DataFrame:
    """Cycles as text, turned so that the smallest module comes first."""
    rows = graph.cycles(f).select(F.slice("nodes", 1, F.size("nodes") - 1).alias("ring"))
    at = F.array_position("ring", F.array_min("ring")).cast("int")
    turned = F.concat(F.slice("ring", at, F.size("ring")), F.slice("ring", F.lit(1), at - 1))
    return rows.select(F.concat_ws(" -> ", turned, F.array_min("ring")).alias("cycle"))


def _gates(f: Facts) -> DataFrame:
    return gates.breaches(f, Gates(max_complexity=5, max_cognitive=3, max_params=1, max_nesting=2, max_lines=12), n_cycles=0)


def _imports(f: Facts) -> DataFrame:
    """Resolved imports as they stand in the files."""
    return _joined(f.table("imports").select("module", "target", "specifiers", "is_internal", "line"), "specifiers")


def _star_sources(f: Facts) -> DataFrame:
    return f.parsed.select("module", F.explode("star_sources").alias("target"))


def _rule_totals(f: Facts) -> DataFrame:
    return audits.rule_audit(f, "eslint").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("unique_rules"))


QUERIES = {
    "py_complexity_topk": _query(PY, lambda f: complexity.complexity(f, 30).select("name", "cc", "cognitive", "params", "nesting", "lines", "file", "line", "is_test", "is_method")),
    "py_cognitive_topk": _query(PY, lambda f: complexity.cognitive(f, 30).select("name", "cognitive", "file", "line")),
    "py_nesting_topk": _query(PY, lambda f: complexity.nesting(f, 30).select("name", "depth", "file", "line")),
    "py_largest_functions": _query(PY, lambda f: inventory.largest_functions(f, 30).select("name", "lines", "file", "line", "is_method")),
    "py_classes": _query(PY, lambda f: inventory.largest_types(f).select("name", "lines", "methods", "file", "line")),
    "py_file_inventory": _query(PY, lambda f: inventory.files_by_lines(f).select("file", "lines")),
    "py_summary": _query(PY, lambda f: inventory.summary(f).select("files", "files_parsed", "parse_errors", "lines", "functions", "classes", "internal_imports")),
    "py_test_prod_split": _query(PY, lambda f: inventory.test_prod(f).drop("lang").withColumn("line_ratio_test", F.round("line_ratio_test", 6)).withColumn("function_ratio_test", F.round("function_ratio_test", 6))),
    "py_top_imported": _query(PY, lambda f: graph.top_imported(f).select("module", "count")),
    "py_edge_count": _query(PY, lambda f: graph.graph_size(f).select("modules", "edges")),
    "py_coupling": _query(PY, lambda f: graph.coupling(f).drop("lang")),
    "py_cycles": _query(PY, _cycles),
    "py_dead_exports": _query(PY, lambda f: exports.dead_exports(f).drop("lang")),
    "py_structural_clones": _query(PY, lambda f: _clones(f, False)),
    "py_exact_clones": _query(PY, lambda f: _clones(f, True)),
    "py_todo_audit": _query(PY, lambda f: _joined(audits.todo_audit(f).drop("lang"), "samples")),
    "py_decorators": _query(PY, frameworks.decorators),
    "py_routes": _query(PY, lambda f: frameworks.routes(f).drop("dependencies")),
    "py_mutable_defaults": _query(PY, frameworks.mutable_defaults),
    "py_silent_excepts": _query(PY, lambda f: frameworks.silent_handlers(f).drop("lang")),
    "py_secrets": _query(PY, lambda f: audits.security_audit(f).drop("lang")),
    "ts_complexity_topk": _query(TS, lambda f: complexity.complexity(f, 30).select("name", "cc", "cognitive", "params", "nesting", "file", "line", "is_component")),
    "ts_cognitive_topk": _query(TS, lambda f: complexity.cognitive(f, 30).select("name", "cognitive", "file", "line")),
    "ts_summary": _query(TS, lambda f: inventory.summary(f).select("files", "lines", "functions", "components", "custom_hooks", "internal_imports", "external_imports")),
    "ts_components": _query(TS, lambda f: _joined(frameworks.components(f).select("name", "file", "line", "hooks"), "hooks")),
    "ts_component_props": _query(TS, lambda f: _joined(frameworks.component_props(f), "props")),
    "ts_hook_frequency": _query(TS, frameworks.hook_frequency),
    "ts_heavy_components": _query(TS, lambda f: _joined(frameworks.heavy_components(f), "hooks")),
    "ts_custom_hooks": _query(TS, frameworks.custom_hooks),
    "ts_external_packages": _query(TS, lambda f: graph.external_packages(f).drop("lang")),
    "ts_coupling": _query(TS, lambda f: graph.coupling(f).drop("lang")),
    "ts_dead_exports": _query(TS, lambda f: exports.dead_exports(f).drop("lang")),
    "ts_boundary_violations": _query(TS, lambda f: frameworks.boundary_violations(f, BOUNDARIES)),
    "ts_console": _query(TS, frameworks.console_debugger),
    "ts_console_by_kind": _query(TS, frameworks.console_by_kind),
    "ts_silent_catches": _query(TS, lambda f: frameworks.silent_handlers(f).drop("lang")),
    "ts_eslint": _query(TS, lambda f: _joined(audits.rule_audit(f, "eslint"), "files")),
    "ts_directives": _query(TS, lambda f: _joined(audits.rule_audit(f, "directive"), "files")),
    "ts_any": _query(TS, frameworks.any_by_file),
    "ts_mobx": _query(TS, frameworks.mobx_observer),
    "ts_orm": _query(TS, frameworks.orm_case),
    "rs_complexity_topk": _query(RS, lambda f: complexity.complexity(f, 30).select("name", "cc", "cognitive", "params", "nesting", "file", "line", "is_method", "is_unsafe")),
    "rs_cognitive_topk": _query(RS, lambda f: complexity.cognitive(f, 30).select("name", "cognitive", "file", "line")),
    "rs_summary": _query(RS, lambda f: inventory.summary(f).select("files", "lines", "functions", "classes", "traits", "internal_imports", "external_imports")),
    "rs_types": _query(RS, lambda f: inventory.largest_types(f).select("name", "kind", "lines", "fields", "methods", "file", "line")),
    "rs_traits": _query(RS, rust_audits.traits),
    "rs_unsafe": _query(RS, rust_audits.unsafe_by_file),
    "rs_unwrap": _query(RS, rust_audits.unwrap_by_file),
    "rs_allow": _query(RS, rust_audits.allow_lints),
    "rs_derive": _query(RS, rust_audits.derive_audit),
    "rs_external_crates": _query(RS, lambda f: graph.external_packages(f).drop("lang")),
    "rs_dead_exports": _query(RS, lambda f: exports.dead_exports(f).drop("lang")),
    "rs_coupling": _query(RS, lambda f: graph.coupling(f).drop("lang")),
    "rs_todo_audit": _query(RS, lambda f: _joined(audits.todo_audit(f).drop("lang"), "samples")),
    "gates": _query(PY, _gates),
    "gate_cycles": _query(PY, lambda f: gates.breaches(f, Gates(max_cycles=0)).select("gate", "value", "limit")),
    "py_marker_total": _query(PY, lambda f: audits.todo_audit(f).agg(F.sum("count").alias("total"))),
    "ts_rule_totals": _query(TS, _rule_totals),
    "py_relative_imports": _query(PY_FORMS, _imports),
    "py_star_imports": _query(PY_FORMS, _star_sources),
    "py_methods": _query(PY_FORMS, lambda f: _joined(f.functions.select("qualname", "params", "is_method", "decorators", "file", "line"), "decorators")),
    "ts_classes": _query(TS_FORMS, lambda f: inventory.largest_types(f).select("name", "lines", "methods", "properties", "has_heritage", "file", "line")),
    "ts_star_exports": _query(TS_FORMS, _star_sources),
    "ts_namespace_imports": _query(TS_FORMS, lambda f: _imports(f).where("is_internal AND specifiers LIKE '* as %'")),
    "ts_own_hooks": _query(TS_FORMS, frameworks.hook_frequency),
    "ts_params": _query(TS_FORMS, lambda f: f.functions.select("name", "params", "file", "line")),
    "ts_structural_clones": _query(TS_FORMS, lambda f: _clones(f, False)),
    "ts_forms_coupling": _query(TS_FORMS, lambda f: graph.coupling(f).drop("lang")),
    "rs_paths": _query(RS_FORMS, _imports),
    "rs_enums": _query(RS_FORMS, lambda f: inventory.largest_types(f).select("name", "kind", "lines", "fields", "methods", "file", "line")),
    "rs_structural_clones": _query(RS_FORMS, lambda f: _clones(f, False)),
    "multi_summary": _query(ALL, lambda f: inventory.summary(f).select("lang", "files", "lines", "functions")),
    "doc_exact_clones": tables.doc_exact_clones,
    "doc_line_inventory": tables.doc_line_inventory,
    "doc_secret_hints": tables.doc_secret_hints,
    "page_link_indegree": tables.page_link_indegree,
    "page_host_frequency": tables.page_host_frequency,
}

# --- the same, in DuckDB SQL on the tables ---------------------------------------------------------

_T = "({k} - {k} % 10 + (({k} % 10) * ({k} % 10) + 1) % 10)"
_D = "(CASE WHEN {k} % 6 = 0 THEN 'tests' ELSE 'm' || ({k} % 7) END)"


def _t(k: str = "k") -> str:
    return _T.format(k=k)


def _module(k: str = "k") -> str:
    return f"('corpus.' || {_D.format(k=k)} || '.part_' || {k})"


#: Python files: keys, shape parameters and line numbers.  The def line follows the optional token line.
_P = f"""
p AS (
    SELECT p_partkey AS k, p_size % 6 AS n, least(p_size % 3, p_size % 6) AS b, p_size % 2 * 10 AS pad FROM part
), f AS (
    SELECT k, n, b, pad, 'corpus/' || {_D.format(k='k')} || '/part_' || k || '.py' AS file, {_module()} AS module, {_module(_t())} AS target, {_t()} AS t,
           1 + n + b AS cc, n * (n + 1) // 2 AS cog, n + 3 + pad AS len, (k % 11 = 0)::INT AS tok, (k % 6 = 0) AS is_test FROM p
), l AS (
    SELECT *, 6 + tok AS def_line, 5 + tok + len AS end_line FROM f
), sized AS (
    SELECT *, end_line + CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 9 = 0 THEN 4 ELSE 0 END + 1 AS helper_line,
           helper_line + CASE WHEN k % 13 = 0 THEN 12 ELSE 0 END AS lines, 1 + (k % 5 = 0)::INT + (k % 13 = 0)::INT AS n_functions FROM l
), fn AS (
    SELECT k, 'run_' || k AS name, cc, cog, n AS depth, 2 AS params, len AS lines, file, def_line AS line, is_test, FALSE AS is_method FROM l
    UNION ALL SELECT k, 'size', 1, 0, 0, 0, 2, file, end_line + 2, is_test, TRUE FROM l WHERE k % 5 = 0
    UNION ALL SELECT k, 'shared_helper', 1, 0, 0, 1, 12, file, helper_line, is_test, FALSE FROM sized WHERE k % 13 = 0
)"""
_C = """
c AS (
    SELECT c_custkey AS k, c_custkey % 5 AS n, least(c_custkey % 3, c_custkey % 5) AS b FROM customer
), f AS (
    SELECT *, 'web/c' || (k % 5) || '/item_' || k || CASE WHEN k % 2 = 1 THEN '.tsx' ELSE '.ts' END AS file, 'c' || (k % 5) || '/item_' || k AS module,
           """ + _t() + """ AS t, 1 + n + b AS cc, n * (n + 1) // 2 + CASE WHEN b >= 1 THEN 1 ELSE 0 END + CASE WHEN b >= 2 THEN 2 ELSE 0 END + b AS cog,
           6 + n + 1 + (n > 0)::INT + 2 AS fn_end FROM c
), l AS (
    SELECT *, CASE WHEN k % 2 = 1 THEN 5 + (k % 3 = 1)::INT + (k % 3 = 2)::INT ELSE 0 END AS card FROM f
), sized AS (
    SELECT *, fn_end + card + (k % 10 = 1)::INT AS hook_line, fn_end + card + (k % 10 = 1)::INT + (k % 8 IN (0, 1))::INT AS catch_line FROM l
)"""
_R = """
s AS (
    SELECT s_suppkey AS k, s_suppkey % 5 AS n, least(s_suppkey % 3, s_suppkey % 5) AS b FROM supplier
), f AS (
    SELECT *, 's' || (k % 3) || '/item_' || k || '.rs' AS file, 's' || (k % 3) || '/item_' || k AS module, """ + _t() + """ AS t, 1 + n + b AS cc,
           n * (n + 1) // 2 + CASE WHEN b >= 1 THEN 1 ELSE 0 END + CASE WHEN b >= 2 THEN 2 ELSE 0 END AS cog FROM s
), l AS (
    SELECT *, 9 + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END AS impl_line, 14 + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END AS run_line,
           14 + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END + n + (n > 0)::INT + (k % 5 = 0)::INT + (k % 6 = 0)::INT + (k % 7 = 0)::INT + 2 AS run_end FROM f
), fn AS (
    SELECT k, 'run_' || k AS name, cc, cog, 2 AS params, n AS depth, file, run_line AS line, FALSE AS is_method, k % 10 = 3 AS is_unsafe FROM l
    UNION ALL SELECT k, 'get', 1, 0, 1, 0, file, impl_line + 1, TRUE, FALSE FROM l
)"""

_SAMPLES = "coalesce(string_agg(CASE WHEN r <= 5 THEN loc END, ',' ORDER BY r), '')"

#: Files of the second corpus.
_S = f"""
s AS (
    SELECT s_suppkey AS k, {_T.format(k='s_suppkey')} AS t, s_suppkey % 3 AS n, 'd' || (s_suppkey % 3) || '/form_' || s_suppkey AS stem FROM supplier
)"""
_CLONED = f"""WITH {_S} SELECT count(*)::BIGINT AS count, min('long_' || k) AS first_name, max('long_' || k) AS last_name, sum({{lines}})::BIGINT AS total_lines FROM s GROUP BY n HAVING count(*) > 1"""

ORACLE_SQL = {
    "py_complexity_topk": f"WITH {_P} SELECT name, cc::BIGINT AS cc, cog::BIGINT AS cognitive, params::BIGINT AS params, depth::BIGINT AS nesting, lines::BIGINT AS lines, file, line::BIGINT AS line, is_test, is_method FROM fn ORDER BY cc DESC, name, file, line LIMIT 30",
    "py_cognitive_topk": f"WITH {_P} SELECT name, cog::BIGINT AS cognitive, file, line::BIGINT AS line FROM fn ORDER BY cog DESC, name, file, line LIMIT 30",
    "py_nesting_topk": f"WITH {_P} SELECT name, depth::BIGINT AS depth, file, line::BIGINT AS line FROM fn WHERE depth > 0 ORDER BY fn.depth DESC, name, file, line LIMIT 30",
    "py_largest_functions": f"WITH {_P} SELECT name, lines::BIGINT AS lines, file, line::BIGINT AS line, is_method FROM fn ORDER BY fn.lines DESC, name, file, line LIMIT 30",
    "py_classes": f"WITH {_P} SELECT 'Box_' || k AS name, 3::BIGINT AS lines, 1::BIGINT AS methods, file, (end_line + 1)::BIGINT AS line FROM l WHERE k % 5 = 0",
    "py_file_inventory": f"WITH {_P} SELECT file, lines::BIGINT AS lines FROM sized",
    "py_summary": f"WITH {_P} SELECT count(*)::BIGINT AS files, count(*)::BIGINT AS files_parsed, 0::BIGINT AS parse_errors, sum(lines)::BIGINT AS lines, sum(n_functions)::BIGINT AS functions, (count(*) FILTER (k % 5 = 0))::BIGINT AS classes, count(*)::BIGINT AS internal_imports FROM sized",
    "py_test_prod_split": f"""WITH {_P}, x AS (SELECT sum(lines) FILTER (is_test)::BIGINT AS tl, sum(lines) FILTER (NOT is_test)::BIGINT AS pl, sum(n_functions + (k % 5 = 0)::INT) FILTER (is_test)::BIGINT AS tf, sum(n_functions + (k % 5 = 0)::INT) FILTER (NOT is_test)::BIGINT AS pf FROM sized)
        SELECT tl AS test_lines, pl AS production_lines, tf AS test_functions, pf AS production_functions, round(tl / (tl + pl), 6) AS line_ratio_test, round(tf / (tf + pf), 6) AS function_ratio_test FROM x""",
    "py_top_imported": f"WITH {_P} SELECT target AS module, count(*)::BIGINT AS count FROM f GROUP BY target",
    "py_edge_count": f"WITH {_P} SELECT count(DISTINCT module)::BIGINT AS modules, count(DISTINCT (module, target))::BIGINT AS edges FROM f",
    "py_coupling": f"""WITH {_P}, i AS (SELECT target AS module, count(DISTINCT module) AS ca FROM f GROUP BY 1), o AS (SELECT module, count(DISTINCT target) AS ce FROM f GROUP BY 1)
        SELECT o.module, coalesce(ca, 0)::BIGINT AS ca, ce::BIGINT AS ce, round(ce / (coalesce(ca, 0) + ce) * 100) / 100 AS instability FROM o LEFT JOIN i USING (module)""",
    "py_cycles": f"""WITH RECURSIVE {_P}, walk AS (
            SELECT k AS start, k AS at, [module] AS path, [k] AS ks FROM f
            UNION ALL SELECT w.start, f.t, list_append(w.path, f2.module), list_append(w.ks, f.t) FROM walk w JOIN f ON f.k = w.at JOIN f f2 ON f2.k = f.t WHERE f.t <> w.start AND NOT list_contains(w.ks, f.t)
        ), closed AS (SELECT w.path FROM walk w JOIN f ON f.k = w.at WHERE f.t = w.start)
        SELECT array_to_string(list_append(path, path[1]), ' -> ') AS cycle FROM closed WHERE path[1] = list_min(path)""",
    "py_dead_exports": f"""WITH {_P}, e AS (SELECT k, module, 'limit' AS name FROM f UNION ALL SELECT k, module, 'token' FROM f WHERE k % 11 = 0 UNION ALL SELECT k, module, 'run_' || k FROM f UNION ALL SELECT k, module, 'Box_' || k FROM f WHERE k % 5 = 0 UNION ALL SELECT k, module, 'shared_helper' FROM f WHERE k % 13 = 0)
        SELECT module, name FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.t = e.k AND e.name = 'run_' || f.t)""",
    "py_structural_clones": f"""WITH {_P}, c AS (SELECT 'run_' || k AS name, len, n || ' ' || b || ' ' || pad AS shape FROM f UNION ALL SELECT 'shared_helper', 12, 'helper' FROM f WHERE k % 13 = 0)
        SELECT count(*)::BIGINT AS count, min(name) AS first_name, max(name) AS last_name, sum(len)::BIGINT AS total_lines FROM c WHERE len > 10 GROUP BY shape HAVING count(*) > 1""",
    "py_exact_clones": f"WITH {_P} SELECT count(*)::BIGINT AS count, 'shared_helper' AS first_name, 'shared_helper' AS last_name, (12 * count(*))::BIGINT AS total_lines FROM f WHERE k % 13 = 0 HAVING count(*) > 1",
    "py_todo_audit": f"""WITH {_P}, m AS (SELECT ['TODO', 'FIXME', 'HACK', 'XXX'][k // 4 % 4 + 1] AS tag, file || ':3' AS loc, file FROM f WHERE k % 4 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY file) AS r FROM m)
        SELECT tag, count(*)::BIGINT AS count, {_SAMPLES} AS samples FROM r GROUP BY tag""",
    "py_decorators": f"WITH {_P} SELECT CASE WHEN k % 8 = 0 THEN 'router.' || ['get', 'post', 'put', 'delete', 'patch'][k % 5 + 1] ELSE 'cached' END AS decorator, count(*)::BIGINT AS count FROM f GROUP BY 1",
    "py_routes": f"WITH {_P} SELECT upper(['get', 'post', 'put', 'delete', 'patch'][k % 5 + 1]) AS method, '/part/' || k AS path, 'run_' || k AS handler, file, def_line::BIGINT AS line FROM l WHERE k % 8 = 0",
    "py_mutable_defaults": f"WITH {_P} SELECT '/src/' || file AS file, def_line::BIGINT AS line, 'run_' || k AS func_name, 'b' AS param_name, 'list' AS kind FROM l WHERE k % 10 = 0",
    "py_silent_excepts": f"WITH {_P} SELECT file, (end_line + CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END + 3)::BIGINT AS line, 'except: pass' AS kind FROM l WHERE k % 9 = 0",
    "py_secrets": f"WITH {_P} SELECT 'github_token' AS kind, file, 5::BIGINT AS line, 'GitHub token' AS detail FROM f WHERE k % 11 = 0",
    "ts_complexity_topk": f"""WITH {_C}, fn AS (SELECT 'fn_' || k AS name, cc, cog, 2 AS params, n AS depth, file, 6 AS line, FALSE AS is_component FROM f UNION ALL SELECT 'Card_' || k, 1, 0, 1, 0, file, fn_end + 1, TRUE FROM f WHERE k % 2 = 1 UNION ALL SELECT 'useThing', 1, 0, 0, 0, file, hook_line, FALSE FROM sized WHERE k % 10 = 1)
        SELECT name, cc::BIGINT AS cc, cog::BIGINT AS cognitive, params::BIGINT AS params, depth::BIGINT AS nesting, file, line::BIGINT AS line, is_component FROM fn ORDER BY fn.cc DESC, name, file, line LIMIT 30""",
    "ts_cognitive_topk": f"WITH {_C} SELECT 'fn_' || k AS name, cog::BIGINT AS cognitive, file, 6::BIGINT AS line FROM f ORDER BY cog DESC, name, file LIMIT 30",
    "ts_summary": f"""WITH {_C} SELECT count(*)::BIGINT AS files, sum(catch_line + (k % 9 = 0)::INT + (k % 12 = 0)::INT)::BIGINT AS lines, sum(1 + k % 2 + (k % 10 = 1)::INT)::BIGINT AS functions, sum(k % 2)::BIGINT AS components,
        sum((k % 10 = 1)::INT)::BIGINT AS custom_hooks, (2 * count(*))::BIGINT AS internal_imports, sum(1 + (k % 4 = 3)::INT)::BIGINT AS external_imports FROM sized""",
    "ts_components": f"WITH {_C} SELECT 'Card_' || k AS name, file, (fn_end + 1)::BIGINT AS line, 'useState,useEffect' || CASE WHEN k % 3 = 1 THEN ',useMemo' WHEN k % 3 = 2 THEN ',useOwn_' || (k % 4) ELSE '' END AS hooks FROM f WHERE k % 2 = 1",
    "ts_component_props": f"WITH {_C} SELECT 'Card_' || k AS name, file, (fn_end + 1)::BIGINT AS line, 'title,width' AS props FROM f WHERE k % 2 = 1",
    "ts_hook_frequency": f"""WITH {_C}, h AS (SELECT 'useState' AS hook FROM f WHERE k % 2 = 1 UNION ALL SELECT 'useEffect' FROM f WHERE k % 2 = 1 UNION ALL SELECT 'useMemo' FROM f WHERE k % 2 = 1 AND k % 3 = 1 UNION ALL SELECT 'useOwn_' || (k % 4) FROM f WHERE k % 2 = 1 AND k % 3 = 2)
        SELECT hook, count(*)::BIGINT AS count, FALSE AS is_custom FROM h GROUP BY hook""",
    "ts_heavy_components": f"WITH {_C} SELECT 'Card_' || k AS name, file, (fn_end + 1)::BIGINT AS line, 3::BIGINT AS hook_count, 'useState,useEffect' || CASE WHEN k % 3 = 1 THEN ',useMemo' ELSE ',useOwn_' || (k % 4) END AS hooks FROM f WHERE k % 2 = 1 AND k % 3 > 0",
    "ts_custom_hooks": f"WITH {_C} SELECT 'useThing' AS name, 1::BIGINT AS lines, file, hook_line::BIGINT AS line FROM sized WHERE k % 10 = 1",
    "ts_external_packages": f"WITH {_C}, x AS (SELECT ['lodash', '@scope/pkg', 'react'][k % 3 + 1] AS package FROM f UNION ALL SELECT 'mobx-react-lite' FROM f WHERE k % 4 = 3) SELECT package, count(*)::BIGINT AS count FROM x GROUP BY 1",
    "ts_coupling": f"""WITH {_C}, e AS (SELECT DISTINCT module, 'c' || (t % 5) || '/item_' || t AS dst FROM f UNION SELECT module, 'hooks/use_thing' FROM f), i AS (SELECT dst AS module, count(*) AS ca FROM e GROUP BY 1), o AS (SELECT module, count(*) AS ce FROM e GROUP BY 1)
        SELECT o.module, coalesce(ca, 0)::BIGINT AS ca, ce::BIGINT AS ce, round(ce / (coalesce(ca, 0) + ce) * 100) / 100 AS instability FROM o LEFT JOIN i USING (module)""",
    "ts_dead_exports": f"""WITH {_C}, e AS (SELECT k, module, 'fn_' || k AS name FROM f UNION ALL SELECT k, module, 'Card_' || k FROM f WHERE k % 2 = 1 UNION ALL SELECT k, module, 'useThing' FROM f WHERE k % 10 = 1)
        SELECT module, name FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.t = e.k AND e.name = 'fn_' || f.t)""",
    "ts_boundary_violations": f"""WITH {_C} SELECT file, 2::BIGINT AS line, '../c' || (t % 5) || '/item_' || t AS import_source, 'web/c1 -> ../c2' AS rule FROM f WHERE k % 5 = 1 AND t % 5 = 2
        UNION ALL SELECT file, 3, 'react', 'web/c1 -> react' FROM f WHERE k % 5 = 1 AND k % 3 = 2 UNION ALL SELECT file, 3, '@scope/pkg/sub', 'web/c -> @scope' FROM f WHERE k % 3 = 1""",
    "ts_console": f"WITH {_C} SELECT file, (7 + n)::BIGINT AS line, CASE WHEN k % 2 = 0 THEN 'console.log' ELSE 'console.warn' END AS kind FROM f UNION ALL SELECT file, (catch_line + (k % 9 = 0)::INT + 1)::BIGINT, 'debugger' FROM sized WHERE k % 12 = 0",
    "ts_console_by_kind": f"WITH {_C}, x AS (SELECT CASE WHEN k % 2 = 0 THEN 'console.log' ELSE 'console.warn' END AS kind FROM f UNION ALL SELECT 'debugger' FROM f WHERE k % 12 = 0) SELECT kind, count(*)::BIGINT AS count FROM x GROUP BY kind",
    "ts_silent_catches": f"WITH {_C} SELECT file, catch_line::BIGINT AS line, CASE WHEN k % 8 = 0 THEN '.catch(() => {{}})' ELSE 'empty catch clause' END AS kind FROM sized WHERE k % 8 IN (0, 1)",
    "ts_eslint": f"""WITH {_C}, m AS (SELECT unnest(['no-console', 'no-alert']) AS rule, file AS loc FROM f WHERE k % 6 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY loc) AS r FROM m)
        SELECT rule, count(*)::BIGINT AS count, {_SAMPLES} AS files FROM r GROUP BY rule""",
    "ts_directives": f"""WITH {_C}, m AS (SELECT '@ts-ignore' AS rule, file AS loc FROM f WHERE k % 6 = 3), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY loc) AS r FROM m)
        SELECT rule, count(*)::BIGINT AS count, {_SAMPLES} AS files FROM r GROUP BY rule""",
    "ts_any": f"WITH {_C} SELECT file, 1::BIGINT AS count FROM f WHERE k % 7 = 0",
    "ts_mobx": f"WITH {_C} SELECT file, (fn_end + 1)::BIGINT AS line, 'Card_' || k AS component, 'exported component not wrapped in observer()' AS kind FROM f WHERE k % 4 = 3",
    "ts_orm": f"WITH {_C} SELECT file, (catch_line + 1)::BIGINT AS line, 'query' AS method, '.userName' AS snippet, 'userName' AS identifier FROM sized WHERE k % 9 = 0",
    "rs_complexity_topk": f"WITH {_R} SELECT name, cc::BIGINT AS cc, cog::BIGINT AS cognitive, params::BIGINT AS params, depth::BIGINT AS nesting, file, line::BIGINT AS line, is_method, is_unsafe FROM fn ORDER BY fn.cc DESC, name, file, line LIMIT 30",
    "rs_cognitive_topk": f"WITH {_R} SELECT name, cog::BIGINT AS cognitive, file, line::BIGINT AS line FROM fn ORDER BY cog DESC, name, file, line LIMIT 30",
    "rs_summary": f"WITH {_R} SELECT count(*)::BIGINT AS files, sum(run_end + 1)::BIGINT AS lines, (2 * count(*))::BIGINT AS functions, count(*)::BIGINT AS classes, (count(*) FILTER (k % 4 = 0))::BIGINT AS traits, count(*)::BIGINT AS internal_imports, sum(1 + k % 2)::BIGINT AS external_imports FROM l",
    "rs_types": f"WITH {_R} SELECT 'Rec_' || k AS name, 'struct' AS kind, 4::BIGINT AS lines, 2::BIGINT AS fields, 1::BIGINT AS methods, file, 5::BIGINT AS line FROM f",
    "rs_traits": f"WITH {_R} SELECT 'Show_' || k AS name, file, 9::BIGINT AS line, 'pub' AS visibility FROM f WHERE k % 4 = 0",
    "rs_unsafe": f"WITH {_R} SELECT file, (k % 6 = 0)::BIGINT AS unsafe_blocks, (k % 10 = 3)::BIGINT AS unsafe_functions FROM f WHERE k % 6 = 0 OR k % 10 = 3",
    "rs_unwrap": f"WITH {_R} SELECT file, 1::BIGINT AS count FROM f WHERE k % 5 = 0",
    "rs_allow": f"WITH {_R} SELECT 'dead_code' AS rule, (2 * count(*))::BIGINT AS count FROM f",
    "rs_derive": f"WITH {_R}, d AS (SELECT unnest(['Debug', 'Clone']) AS derive FROM f UNION ALL SELECT 'Serialize' FROM f WHERE k % 3 = 0) SELECT derive, (2 * count(*))::BIGINT AS count FROM d GROUP BY derive",
    "rs_external_crates": f"WITH {_R}, d AS (SELECT 'serde' AS package FROM f WHERE k % 2 = 0 UNION ALL SELECT unnest(['std', 'std']) FROM f WHERE k % 2 = 1) SELECT package, count(*)::BIGINT AS count FROM d GROUP BY package",
    "rs_dead_exports": f"WITH {_R} SELECT module, unnest(['Rec_' || k, 'Rec_' || k || '::get', 'run_' || k]) AS name FROM f UNION ALL SELECT module, 'Show_' || k FROM f WHERE k % 4 = 0",
    "rs_coupling": f"WITH {_R} SELECT module, 0::BIGINT AS ca, 1::BIGINT AS ce, 1.0::DOUBLE AS instability FROM f",
    "rs_todo_audit": f"""WITH {_R}, m AS (SELECT file, file || ':' || (run_end - 2) AS loc FROM l WHERE k % 7 = 0), r AS (SELECT *, row_number() OVER (ORDER BY file) AS r FROM m) SELECT 'TODO' AS tag, count(*)::BIGINT AS count, {_SAMPLES} AS samples FROM r HAVING count(*) > 0""",
    "gates": f"""WITH {_P}, x AS (
            (SELECT 'max-complexity' AS gate, cc AS value, 5 AS lim, name, file, line FROM fn WHERE cc > 5 ORDER BY fn.cc DESC, name, file, line LIMIT 1)
            UNION ALL (SELECT 'max-cognitive-complexity', cog, 3, name, file, line FROM fn WHERE cog > 3 ORDER BY fn.cc DESC, name, file, line LIMIT 1)
            UNION ALL (SELECT 'max-params', params, 1, name, file, line FROM fn WHERE params > 1 ORDER BY fn.cc DESC, name, file, line LIMIT 1)
            UNION ALL (SELECT 'max-nesting', depth, 2, name, file, line FROM fn WHERE depth > 2 ORDER BY fn.depth DESC, name, file, line LIMIT 1)
            UNION ALL (SELECT 'max-lines', lines, 12, name, file, line FROM fn WHERE lines > 12 ORDER BY fn.cc DESC, name, file, line LIMIT 1))
        SELECT gate, value::BIGINT AS value, lim::BIGINT AS "limit", name, file, line::BIGINT AS line FROM x""",
    "gate_cycles": f"""WITH RECURSIVE {_P}, walk AS (
            SELECT k AS start, k AS at, [k] AS ks FROM f
            UNION ALL SELECT w.start, f.t, list_append(w.ks, f.t) FROM walk w JOIN f ON f.k = w.at WHERE f.t <> w.start AND NOT list_contains(w.ks, f.t) AND EXISTS (SELECT 1 FROM f g WHERE g.k = f.t)
        ), closed AS (SELECT w.ks FROM walk w JOIN f ON f.k = w.at WHERE f.t = w.start AND w.start = list_min(w.ks))
        SELECT 'max-cycles' AS gate, count(*)::BIGINT AS value, 0::BIGINT AS "limit" FROM closed HAVING count(*) > 0""",
    "py_marker_total": f"WITH {_P} SELECT count(*)::BIGINT AS total FROM f WHERE k % 4 = 0",
    "ts_rule_totals": f"WITH {_C} SELECT (2 * count(*))::BIGINT AS total, CASE WHEN count(*) > 0 THEN 2 ELSE 0 END::BIGINT AS unique_rules FROM f WHERE k % 6 = 0",
    "py_relative_imports": f"""WITH {_S}, m AS (SELECT *, 'forms.lib.d' || n || '.form_' || k AS module FROM s)
        SELECT module, 'forms.lib.d' || n || '.form_' || t AS target, 'size' AS specifiers, TRUE AS is_internal, 1::BIGINT AS line FROM m
        UNION ALL SELECT module, 'forms.lib.util_' || (k % 2), '*', TRUE, 2 FROM m UNION ALL SELECT module, 'forms.top', 'thing,other', TRUE, 3 FROM m""",
    "py_star_imports": f"WITH {_S} SELECT 'forms.lib.d' || n || '.form_' || k AS module, 'forms.util_' || (k % 2) AS target FROM s",
    "py_methods": f"""WITH {_S}, m AS (SELECT *, 'forms/lib/' || stem || '.py' AS file FROM s)
        SELECT 'Box_' || k || '.size' AS qualname, 1::BIGINT AS params, TRUE AS is_method, '@cached(ttl=' || (k % 4) || ')' AS decorators, file, 6::BIGINT AS line FROM m
        UNION ALL SELECT 'Box_' || k || '.pull', 2, TRUE, '', file, 8 FROM m WHERE n = 0""",
    "ts_classes": f"WITH {_S} SELECT 'Box_' || k AS name, 5::BIGINT AS lines, 2::BIGINT AS methods, 1::BIGINT AS properties, k % 2 = 0 AS has_heritage, 'forms/' || stem || '.tsx' AS file, 3::BIGINT AS line FROM s",
    "ts_star_exports": f"WITH {_S} SELECT stem AS module, 'd' || unnest([n, t % 3]) || '/form_' || t AS target FROM s",
    "ts_namespace_imports": f"WITH {_S} SELECT stem AS module, 'd' || (t % 3) || '/form_' || t AS target, '* as util' AS specifiers, TRUE AS is_internal, 2::BIGINT AS line FROM s",
    "ts_own_hooks": f"WITH {_S} SELECT 'useOwn_' || (k % 4) AS hook, count(*)::BIGINT AS count, TRUE AS is_custom FROM s GROUP BY 1",
    "ts_params": f"""WITH {_S}, m AS (SELECT *, 'forms/' || stem || '.tsx' AS file FROM s)
        SELECT 'useOwn_' || (k % 4) AS name, 0::BIGINT AS params, file, 8::BIGINT AS line FROM m UNION ALL SELECT 'Card_' || k, 0, file, 9 FROM m UNION ALL SELECT 'long_' || k, 1, file, 13 FROM m UNION ALL SELECT 'run', 1, file, 6 FROM m""",
    "ts_structural_clones": _CLONED.format(lines="13 + 2 * n"),
    "ts_forms_coupling": f"""WITH {_S}, e AS (SELECT DISTINCT stem AS module, 'd' || (t % 3) || '/form_' || t AS dst FROM s), i AS (SELECT dst AS module, count(*) AS ca FROM e GROUP BY 1)
        SELECT e.module, coalesce(ca, 0)::BIGINT AS ca, 1::BIGINT AS ce, round(1 / (coalesce(ca, 0) + 1) * 100) / 100 AS instability FROM e LEFT JOIN i USING (module)""",
    "rs_paths": f"""WITH {_S} SELECT stem AS module, stem || '/inner/one' AS target, 'one' AS specifiers, TRUE AS is_internal, 1::BIGINT AS line FROM s
        UNION ALL SELECT stem, 'd' || n || '/form_' || t || '/long_' || t, 'long_' || t, TRUE, 2 FROM s UNION ALL SELECT stem, 'top', 'top', TRUE, 3 FROM s""",
    "rs_enums": f"WITH {_S} SELECT 'Kind_' || k AS name, 'enum' AS kind, (3 + (k % 2 = 0)::INT)::BIGINT AS lines, (2 + (k % 2 = 0)::INT)::BIGINT AS fields, 0::BIGINT AS methods, stem || '.rs' AS file, 4::BIGINT AS line FROM s",
    "rs_structural_clones": _CLONED.format(lines="13 + 2 * n"),
    "multi_summary": f"""SELECT 'python' AS lang, files, lines, functions FROM (WITH {_P} SELECT count(*)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(n_functions)::BIGINT AS functions FROM sized)
        UNION ALL SELECT 'typescript', files, lines, functions FROM (WITH {_C} SELECT count(*)::BIGINT AS files, sum(catch_line + (k % 9 = 0)::INT + (k % 12 = 0)::INT)::BIGINT AS lines, sum(1 + k % 2 + (k % 10 = 1)::INT)::BIGINT AS functions FROM sized)
        UNION ALL SELECT 'rust', files, lines, functions FROM (WITH {_R} SELECT count(*)::BIGINT AS files, sum(run_end + 1)::BIGINT AS lines, (2 * count(*))::BIGINT AS functions FROM l)""",
    **tables.SQL,
}
