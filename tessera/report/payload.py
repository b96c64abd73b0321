"""Reports as DataFrames by section, and as one nested document per language."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..operators import audits, clones, complexity, exports, frameworks, graph, inventory, rust_audits
from ..plans.facts import Facts

# The columns of each section's rows, by language where they differ.
_FLAGS = {"python": ["is_method"], "typescript": ["is_component"], "rust": ["is_method"]}


class LanguageReport:
    """One language's sections; a DataFrame is built when asked for and run when collected."""

    def __init__(self, facts: Facts, lang: str, config: ScanConfig):
        self.lang, self.config = lang, config
        self.facts = Facts(facts.nested.where(F.col("lang") == lang))

    def sections(self) -> dict[str, DataFrame]:
        """Every section of this language as rows; keys with a dot are nested in the document."""
        f, lang = self.facts, self.lang
        flags = _FLAGS[lang]
        lines = [] if lang == "rust" else ["lines"]
        extra = ["is_test", *flags] + (["is_unsafe"] if lang == "rust" else [])
        out = {
            "inventory.files_by_lines": inventory.files_by_lines(f).select("file", "lines"),
            "inventory.largest_functions": inventory.largest_functions(f).select("name", "lines", "file", "line", *flags),
            "complexity": complexity.complexity(f).select("name", "cc", "cognitive", "params", "nesting", *lines, "file", "line", *extra),
            "cognitive": complexity.cognitive(f).select("name", "cognitive", "file", "line", *flags),
            "nesting": complexity.nesting(f).select("name", "depth", "file", "line", *flags),
            "code_clones": clones.clone_groups(f).select("hash", "count", "functions"),
            "security_audit.findings": audits.security_audit(f).select("kind", "file", "line", "detail"),
            "imports.top_imported": graph.top_imported(f).select("module", "count"),
            "coupling": graph.coupling(f).select("module", "ca", "ce", "instability"),
            "cycles_raw": graph.cycles(f).orderBy("ordinal").select("nodes", "text"),
            "dead_exports": exports.dead_exports(f).select("module", "name"),
            "todo_audit.by_tag": audits.todo_audit(f).select("tag", "count", "samples"),
        }
        if lang != "rust":
            out["type1_clones"] = clones.clone_groups(f, exact=True).select("hash", "count", "functions")
        if lang != "typescript":
            out["parse_errors"] = inventory.parse_errors(f).select("file", "message")
        return out | getattr(self, f"_{lang}")()

    def _python(self) -> dict[str, DataFrame]:
        f = self.facts
        return {
            "inventory.largest_classes": inventory.largest_types(f).select("name", "lines", "methods", "file", "line"),
            "mutable_defaults": frameworks.mutable_defaults(f),
            "silent_excepts": frameworks.silent_handlers(f).select("file", "line", "kind"),
            "decorators": frameworks.decorators(f),
            "routes": frameworks.routes(f),
        }

    def _typescript(self) -> dict[str, DataFrame]:
        f = self.facts
        return {
            "inventory.largest_classes": inventory.largest_types(f).select("name", "lines", "methods", "properties", "has_heritage", "file", "line"),
            "imports.external_packages": graph.external_packages(f).select("package", "count"),
            "component_props": frameworks.component_props(f),
            "hooks.frequency": frameworks.hook_frequency(f),
            "hooks.custom_hooks_inventory": frameworks.custom_hooks(f),
            "hooks.heavy_components": frameworks.heavy_components(f),
            "console_debugger.by_kind": frameworks.console_by_kind(f),
            "console_debugger.items": frameworks.console_debugger(f),
            "silent_catches": frameworks.silent_handlers(f).select("file", "line", "kind"),
            "eslint_disables.by_rule": audits.rule_audit(f, "eslint"),
            "any_audit.by_file": frameworks.any_by_file(f),
            "ts_directives.by_directive": audits.rule_audit(f, "directive").withColumnRenamed("rule", "directive"),
            "mobx_observer": frameworks.mobx_observer(f),
            **({"orm_case_check.findings": frameworks.orm_case(f)} if self.config.orm_methods else {}),
            **({"import_boundaries.violations": frameworks.boundary_violations(f, self.config.boundaries)} if self.config.boundaries else {}),
        }

    def _rust(self) -> dict[str, DataFrame]:
        f = self.facts
        return {
            "inventory.largest_types": inventory.largest_types(f).select("name", "kind", "lines", "fields", "methods", "file", "line"),
            "imports.external_crates": graph.external_packages(f).select(F.col("package").alias("crate"), "count"),
            "traits_inventory": rust_audits.traits(f),
            "unsafe_audit.by_file": rust_audits.unsafe_by_file(f),
            "unwrap_audit.by_file": rust_audits.unwrap_by_file(f),
            "allow_lints.by_rule": rust_audits.allow_lints(f),
            "derive_audit.by_derive": rust_audits.derive_audit(f),
        }

    def payload(self) -> dict:
        """The whole document: a report of one source tree, collected."""
        doc: dict = {"scanner": self.lang, "scan_root": self.config.root}
        if self.lang == "python":
            doc["package"] = self.config.package
        if self.lang == "typescript":
            doc["alias_prefix"] = self.config.alias
        for path, frame in self.sections().items():
            at = doc
            *parents, last = path.split(".")
            for name in parents:
                at = at.setdefault(name, {})
            at[last] = [row.asDict(recursive=True) for row in frame.collect()]
        doc["cycles"] = [r["text"] for r in doc["cycles_raw"]]
        doc["cycles_raw"] = [r["nodes"] for r in doc["cycles_raw"]]
        self._totals(doc)
        return doc

    def _totals(self, doc: dict) -> None:
        row = inventory.summary(self.facts).collect()
        s = row[0].asDict() if row else dict.fromkeys(("files", "files_parsed", "parse_errors", "lines", "functions", "classes", "traits", "internal_imports", "external_imports", "components", "custom_hooks"), 0)
        own = {
            "python": ["files", "files_parsed", "parse_errors", "lines", "functions", "classes", "internal_imports"],
            "typescript": ["files", "lines", "functions", "classes", "components", "custom_hooks", "internal_imports", "external_imports"],
            "rust": ["files", "lines", "functions", "traits", "internal_imports", "external_imports", "parse_errors"],
        }[self.lang]
        doc["summary"] = {k: s[k] for k in own}
        if self.lang == "rust":
            doc["summary"]["structs_enums"] = s["classes"]
        split = inventory.test_prod(self.facts).drop("lang").collect()
        names = ("test_lines", "production_lines", "test_functions", "production_functions")
        doc["summary"]["test_prod"] = split[0].asDict() if split else dict.fromkeys(names, 0) | {"line_ratio_test": 0.0, "function_ratio_test": 0.0}
        size = graph.graph_size(self.facts).collect()
        doc["imports"] |= {"modules": size[0]["modules"] if size else 0, "edges": size[0]["edges"] if size else 0}
        total = lambda rows, key="count": sum(r[key] for r in rows)
        doc["security_audit"]["total"] = len(doc["security_audit"]["findings"])
        doc["todo_audit"]["total"] = total(doc["todo_audit"]["by_tag"])
        if self.lang == "typescript":
            doc["console_debugger"]["total"] = len(doc["console_debugger"]["items"])
            doc["eslint_disables"] |= {"total": total(doc["eslint_disables"]["by_rule"]), "unique_rules": len(doc["eslint_disables"]["by_rule"])}
            doc["any_audit"]["total"] = total(doc["any_audit"]["by_file"])
            doc["ts_directives"]["total"] = total(doc["ts_directives"]["by_directive"])
            doc["orm_case_check"] = {"methods": sorted(self.config.orm_methods), "findings": doc["orm_case_check"]["findings"]} if self.config.orm_methods else None
            rules = [{"source": r.source, "forbidden": list(r.forbidden)} for r in self.config.boundaries]
            doc["import_boundaries"] = {"rules": rules, "violations": doc["import_boundaries"]["violations"]} if rules else None
        if self.lang == "rust":
            by_file = doc["unsafe_audit"]["by_file"]
            doc["unsafe_audit"] |= {"unsafe_blocks": total(by_file, "unsafe_blocks"), "unsafe_functions": total(by_file, "unsafe_functions")}
            for name, rows in (("unwrap_audit", "by_file"), ("allow_lints", "by_rule"), ("derive_audit", "by_derive")):
                doc[name]["total"] = total(doc[name][rows])


def to_json(documents: dict[str, dict], title: str) -> str:
    """One language's document with its title, or all by language."""
    whole = dict(next(iter(documents.values()))) if len(documents) == 1 else dict(documents)
    return json.dumps(whole | {"report_title": title}, sort_keys=True, indent=2, ensure_ascii=False)


def write_sections(report: LanguageReport, folder: str) -> None:
    """Every section as Parquet under ``folder``, without collecting: the sink for corpora too large for one document."""
    for path, frame in report.sections().items():
        frame.write.mode("overwrite").parquet(f"{folder}/{report.lang}/{path}")
