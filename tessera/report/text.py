"""Text reports: a list of sections over a collected document."""

from __future__ import annotations

from collections.abc import Callable, Iterable

WIDTH = 72
#: Rows of sections that do not follow ``top``, and members shown of a clone group.
SECRETS, ERRORS, MEMBERS = 50, 50, 8


def _place(row: dict) -> str:
    return f"[{row['file']}:{row['line']}]"


def _header(title: str) -> list[str]:
    return ["", "=" * WIDTH, f"  {title}", "=" * WIDTH]


def _sub(title: str) -> list[str]:
    return ["", f"  {title}", "  " + "-" * 60]


def _flag(row: dict) -> str:
    return "  (method)" if row.get("is_method") else "  (component)" if row.get("is_component") else ""


def _lines_of(rows: Iterable[dict], top: int) -> list[str]:
    return [f"  {r['lines']:>5} lines  {r['name']}  {_place(r)}" for r in list(rows)[:top]]


def _counted(rows: list[dict], key: str, top: int) -> list[str]:
    return [f"  {r['count']:>4}x  {r[key]}" for r in rows[:top]]


def _more(n: int, shown: int) -> list[str]:
    return [f"  ... and {n - shown} more"] if n > shown else []


class Section:
    """name for ``--skip``, heading, and the lines it prints; ``always`` prints a heading over nothing too."""

    def __init__(self, name: str, heading: str, lines: Callable[[dict, int], list[str]], always: bool = False, skippable: bool = True):
        self.name, self.heading, self.lines, self.always, self.skippable = name, heading, lines, always, skippable

    def render(self, doc: dict, top: int) -> list[str]:
        body = self.lines(doc, top)
        if not body and not self.always:
            return []
        return [*_header(self.heading.format(top=top, ranked=max(top, 30))), *(body or ["  None found."])]


def _inventory(types: str, label: str):
    def lines(doc: dict, top: int) -> list[str]:
        inv = doc["inventory"]
        return [
            *(f"  {r['lines']:>5} lines  {r['file']}" for r in inv["files_by_lines"][:top]),
            *_sub(f"Top {top} Largest Functions"),
            *_lines_of(inv["largest_functions"], top),
            *_sub(f"Top {top} Largest {label}"),
            *_lines_of(inv[types], top),
        ]

    return lines


def _complexity(doc: dict, top: int) -> list[str]:
    return [f"  CC={r['cc']:<4} cog={r['cognitive']:<4} params={r['params']:<3} {r['name']}  {_place(r)}{_flag(r)}" for r in doc["complexity"][: max(top, 30)]]


def _cognitive(doc: dict, top: int) -> list[str]:
    return [f"  {r['cognitive']:>5}  {r['name']}  {_place(r)}{_flag(r)}" for r in doc["cognitive"][: max(top, 30)] if r["cognitive"]]


def _nesting(doc: dict, top: int) -> list[str]:
    return [f"  depth={r['depth']:<3} {r['name']}  {_place(r)}{_flag(r)}" for r in doc["nesting"][: max(top, 30)]]


def _clones(key: str):
    def lines(doc: dict, top: int) -> list[str]:
        out = []
        for group in doc.get(key, [])[:top]:
            out.append(f"  {group['count']} functions share {group['hash']}")
            out += [f"      {m['name']}  {_place(m)}  ({m['lines']} lines)" for m in group["functions"][:MEMBERS]]
            out += ["    " + line for line in _more(group["count"], min(MEMBERS, len(group["functions"])))]
        return out

    return lines


def _imports(packages: str | None, key: str):
    def lines(doc: dict, top: int) -> list[str]:
        i = doc["imports"]
        out = [f"  Internal modules:      {i['modules']}", f"  Internal import edges: {i['edges']}", *_sub(f"Top {top} Most-Imported Internal Modules"), *_counted(i["top_imported"], "module", top)]
        if packages:
            out += [*_sub("External Packages"), *_counted(i[packages], key, min(top, 15))]
        return out

    return lines


def _coupling(doc: dict, top: int) -> list[str]:
    rows = doc["coupling"][:top]
    return ([f"  {'MODULE':<42} {'Ca':>4} {'Ce':>4} {'I':>5}", "  " + "-" * 60] + [f"  {r['module']:<42} {r['ca']:>4} {r['ce']:>4} {r['instability']:>5.2f}" for r in rows]) if rows else []


def _cycles(doc: dict, top: int) -> list[str]:
    return [f"  {text}" for text in doc["cycles"]]


def _dead(doc: dict, top: int) -> list[str]:
    rows, cap = doc["dead_exports"], max(80, 4 * top)
    return [*(f"  {r['module']}: {r['name']}" for r in rows[:cap]), *_more(len(rows), cap)]


def _todo(doc: dict, top: int) -> list[str]:
    audit = doc["todo_audit"]
    return [f"  {r['count']:>4}x  {r['tag']}  e.g. {', '.join(r['samples'])}" for r in audit["by_tag"]] + ([f"  Total: {audit['total']}"] if audit["total"] else [])


def _security(doc: dict, top: int) -> list[str]:
    rows = doc["security_audit"]["findings"]
    return [*(f"  {r['kind']}  {_place(r)}  {r['detail']}" for r in rows[:SECRETS]), *_more(len(rows), SECRETS)]


def _placed(*path: str):
    def lines(doc: dict, top: int) -> list[str]:
        rows = doc
        for name in path:
            rows = rows[name]
        return [f"  {r['kind']}  {_place(r)}" + (f"  {r['component']}" if "component" in r else "") for r in rows]

    return lines


def _frequency(*path: str, key: str, least: int = 0):
    def lines(doc: dict, top: int) -> list[str]:
        rows = doc
        for name in path:
            rows = rows[name]
        return _counted(rows, key, max(top, least))

    return lines


def _errors(doc: dict, top: int) -> list[str]:
    rows = doc["parse_errors"]
    return [*(f"  {r['file']}: {r['message']}" for r in rows[:ERRORS]), *_more(len(rows), ERRORS)]


def _defaults(doc: dict, top: int) -> list[str]:
    return [f"  {r['func_name']}({r['param_name']}) = {r['kind']}  {_place(r)}" for r in doc["mutable_defaults"]]


def _routes(doc: dict, top: int) -> list[str]:
    rows = doc["routes"]
    return ([f"  {'METHOD':<8} {'PATH':<40} {'HANDLER':<30} FILE"] + [f"  {r['method']:<8} {r['path']:<40} {r['handler']:<30} {r['file']}:{r['line']}" for r in rows]) if rows else []


def _props(doc: dict, top: int) -> list[str]:
    return [f"  {r['name']}  {_place(r)}: {', '.join(r['props'])}" for r in doc["component_props"]]


def _hooks(doc: dict, top: int) -> list[str]:
    h = doc["hooks"]
    if not any(h.values()):
        return []
    return [
        *(f"  {r['count']:>4}x  {r['hook']}{'  (custom)' if r['is_custom'] else ''}" for r in h["frequency"][:top]),
        *_sub("Custom Hooks"),
        *_lines_of(h["custom_hooks_inventory"], len(h["custom_hooks_inventory"])),
        *_sub("Components With Three Or More Hooks"),
        *(f"  {r['hook_count']} hooks  {r['name']}  {_place(r)}: {', '.join(r['hooks'])}" for r in h["heavy_components"][:top]),
    ]


def _orm(doc: dict, top: int) -> list[str]:
    check = doc["orm_case_check"]
    return [f"  {r['method']}: {r['snippet']}  {_place(r)}" for r in check["findings"]] if check else []


def _boundaries(doc: dict, top: int) -> list[str]:
    check = doc["import_boundaries"]
    return [f"  {r['rule']}: {r['import_source']}  {_place(r)}" for r in check["violations"]] if check else []


def _traits(doc: dict, top: int) -> list[str]:
    return [f"  {r['name']}  {_place(r)}  {r['visibility']}".rstrip() for r in doc["traits_inventory"][: max(top, 50)]]


def _unsafe(doc: dict, top: int) -> list[str]:
    a = doc["unsafe_audit"]
    rows = [f"  {r['unsafe_blocks']:>4} blocks {r['unsafe_functions']:>4} fns  {r['file']}" for r in a["by_file"][: max(top, 30)]]
    return [f"  Unsafe functions: {a['unsafe_functions']}, unsafe blocks: {a['unsafe_blocks']}", *rows]


_COMMON_TAIL = [
    Section("todo-audit", "6. TODO / FIXME / HACK COMMENTS", _todo),
    Section("security-audit", "HARD-CODED SECRETS (heuristic)", _security),
]


def _head(types: str, label: str, packages: str | None, key: str, dead: str) -> list[Section]:
    return [
        Section("inventory", "1. INVENTORY — Top {top} Largest Files", _inventory(types, label), always=True),
        Section("complexity", "2. CYCLOMATIC COMPLEXITY — Top {ranked}", _complexity, always=True),
        Section("cognitive", "2a. COGNITIVE COMPLEXITY — Top {ranked}", _cognitive),
        Section("nesting", "2b. NESTING DEPTH — Top {ranked}", _nesting),
        Section("imports", "3. IMPORT DEPENDENCY GRAPH", _imports(packages, key), always=True),
        Section("coupling", "3b. MODULE COUPLING — Top {top}", _coupling),
        Section("cycles", "4. CIRCULAR IMPORTS", _cycles, always=True),
        Section("code-clones", "4b. IDENTICAL FUNCTIONS (same text)", _clones("type1_clones")),
        Section("code-clones", "4c. SIMILAR FUNCTIONS (same structure)", _clones("code_clones")),
        Section("dead-exports", f"5. DEAD EXPORTS ({dead})", _dead, always=True),
    ]


LAYOUTS = {
    "python": [
        *_head("largest_classes", "Classes", None, "", "exported but never imported internally"),
        *_COMMON_TAIL,
        Section("silent-except", "7. SILENT EXCEPTION HANDLERS", _placed("silent_excepts"), always=True),
        Section("mutable-defaults", "7b. MUTABLE DEFAULT ARGUMENTS", _defaults, always=True),
        Section("decorators", "8. DECORATOR AUDIT", _frequency("decorators", key="decorator"), always=True),
        Section("routes", "9. API ROUTES", _routes, always=True),
        Section("parse-errors", "PARSE ERRORS (skipped)", _errors, skippable=False),
    ],
    "typescript": [
        *_head("largest_classes", "Classes", "external_packages", "package", "exported but never imported internally"),
        *_COMMON_TAIL,
        Section("component-props", "7. COMPONENT PROPS", _props),
        Section("hooks", "8. HOOKS", _hooks),
        Section("silent-catches", "9. SILENT CATCHES", _placed("silent_catches"), always=True),
        Section("console-debugger", "10. CONSOLE / DEBUGGER", _frequency("console_debugger", "by_kind", key="kind"), always=True),
        Section("eslint-disables", "11. ESLINT SUPPRESSIONS", _frequency("eslint_disables", "by_rule", key="rule")),
        Section("ts-directives", "12. COMPILER DIRECTIVES", _frequency("ts_directives", "by_directive", key="directive")),
        Section("any-audit", "13. EXPLICIT any", _frequency("any_audit", "by_file", key="file")),
        Section("mobx-observer", "14. COMPONENTS WITHOUT observer()", _placed("mobx_observer")),
        Section("orm-case-check", "15. camelCase IN ORM STRINGS", _orm),
        Section("import-boundaries", "16. IMPORT BOUNDARIES", _boundaries),
    ],
    "rust": [
        *_head("largest_types", "Structs / Enums", "external_crates", "crate", "pub, never imported internally by name"),
        *_COMMON_TAIL,
        Section("unsafe-audit", "7. UNSAFE AUDIT", _unsafe, always=True),
        Section("unwrap-audit", "7b. UNWRAP / EXPECT AUDIT", _frequency("unwrap_audit", "by_file", key="file", least=30), always=True),
        Section("allow-lints", "8. #[allow(...)] LINT AUDIT", _frequency("allow_lints", "by_rule", key="rule", least=40), always=True),
        Section("derive-audit", "9. DERIVE AUDIT", _frequency("derive_audit", "by_derive", key="derive", least=40), always=True),
        Section("traits", "10. TRAITS", _traits),
        Section("parse-errors", "PARSE ERRORS (skipped)", _errors),
    ],
}

_SUMMARY = {
    "python": [("files", "Files analyzed"), ("files_parsed", "Files parsed"), ("lines", "Total lines"), ("functions", "Functions"), ("classes", "Classes"), ("internal_imports", "Internal imports"), ("parse_errors", "Parse errors")],
    "typescript": [("files", "Files analyzed"), ("lines", "Total lines"), ("functions", "Functions"), ("classes", "Classes"), ("components", "Components"), ("custom_hooks", "Custom hooks"), ("internal_imports", "Internal imports"), ("external_imports", "External imports")],
    "rust": [("files", "Files analyzed"), ("lines", "Total lines"), ("functions", "Functions"), ("structs_enums", "Structs / enums"), ("traits", "Traits"), ("internal_imports", "Internal imports"), ("external_imports", "External imports"), ("parse_errors", "Parse errors")],
}


def _summary(doc: dict, title: str, skip: frozenset[str]) -> list[str]:
    s, grouped = doc["summary"], doc["scanner"] != "python"
    out = ["=" * WIDTH, f"  {title}", "=" * WIDTH, ""]
    out += [f"  {label + ':':<20} {s[key]:,}" if key == "lines" and grouped else f"  {label + ':':<20} {s[key]}" for key, label in _SUMMARY[doc["scanner"]]]
    if "test-prod" not in skip:
        t = s["test_prod"]
        out.append(f"  {'Test / production:':<20} {t['test_lines']} / {t['production_lines']} lines ({100 * t['line_ratio_test']:.1f}% test), {t['test_functions']} / {t['production_functions']} functions ({100 * t['function_ratio_test']:.1f}% test)")
    return out


def render(doc: dict, title: str, top: int = 20, skip: frozenset[str] = frozenset()) -> str:
    """The text report of one language's document."""
    out = _summary(doc, title, skip)
    for section in LAYOUTS[doc["scanner"]]:
        if section.name not in skip or not section.skippable:
            out += section.render(doc, top)
    return "\n".join([*out, "", "=" * WIDTH, "  END OF REPORT", "=" * WIDTH, ""])


def digest(doc: dict, title: str, cap: int = 10) -> str:
    """A short Markdown digest of a document: totals, worst functions, and non-empty audits."""
    out = [f"# {title}", "", *(f"- {label}: {doc['summary'][key]}" for key, label in _SUMMARY[doc["scanner"]])]
    out += ["", "## Most complex functions", "", "| function | cc | cognitive | place |", "| --- | --- | --- | --- |"]
    out += [f"| {r['name']} | {r['cc']} | {r['cognitive']} | {r['file']}:{r['line']} |" for r in doc["complexity"][:cap]]
    for section in LAYOUTS[doc["scanner"]]:
        if section.name in ("inventory", "complexity", "imports"):
            continue
        body = section.lines(doc, cap)
        if body:
            out += ["", f"## {section.heading.format(top=cap, ranked=cap)}", "", *(f"- {line.strip()}" for line in body[:cap])]
    return "\n".join(out) + "\n"
