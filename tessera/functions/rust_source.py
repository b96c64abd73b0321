"""Facts of one Rust file."""

from __future__ import annotations

import bisect

from .common import Node, ParseFailure, audit_literal, digest, empty_facts, finding
from .rust_parser import parse

_BRANCHES = frozenset("If While For Loop".split())
#: Kinds that a shape leaves out, and kinds whose insides it leaves out.
_SILENT, _OPAQUE = frozenset({"Semi", "Paren"}), frozenset("Async Break Macro Range Continue".split())


def metrics(block: Node) -> dict:
    """Complexity, cognitive score, nesting, unsafe blocks and unwraps of a body, in one walk."""
    complexity, score, deepest, unsafe, unwraps = 1, 0, 0, 0, 0
    todo: list[tuple[Node, int, int]] = [(block, 0, 0)]  # node, weight, nesting depth
    while todo:
        node, weight, depth = todo.pop()
        kind, inner = node.kind, {}
        if kind in _BRANCHES:
            complexity += 1
            score += 1 + weight
            inner = {id(k): weight + (k is not node.cond) for k in node.kids}
        elif kind == "Match":
            complexity += max(node.arms, 1)
            score += 1 + weight
            inner = {id(k): weight + (k is not node.subject) for k in node.kids}
        elif kind == "Binary" and node.op in ("&&", "||"):
            complexity += 1
            score += 1 + weight
        elif kind == "Try":
            complexity += 1
            score += 1 + weight
            inner = {id(k): weight + 1 for k in node.kids}
        elif kind == "Unsafe":
            unsafe += 1
        elif kind == "MethodCall" and node.name in ("unwrap", "expect"):
            unwraps += 1
        if kind in _BRANCHES or kind == "Match":
            depth += 1
            deepest = max(deepest, depth)
        todo.extend((k, inner.get(id(k), weight), depth) for k in node.kids)
    return {"complexity": complexity, "cognitive": score, "nesting": deepest, "unsafe_blocks": unsafe, "unwrap_expect": unwraps}


def shape(block: Node) -> str:
    out: list[str] = []
    todo = [block]
    while todo:
        node = todo.pop()
        if node.kind not in _SILENT:
            out.append("Literal" if node.kind == "Str" else node.kind)
        if node.kind not in _OPAQUE:
            todo.extend(reversed(node.kids))
    return "|".join(out)


def is_test_path(display: str) -> bool:
    lower = display.lower()
    return "/tests/" in lower or lower.startswith("tests/") or lower.endswith("_test.rs") or "/test_" in lower


def module_id(below_root: str) -> str:
    return below_root.removesuffix(".rs").removesuffix("/mod")


def resolve(module: str, segments: list[str]) -> str:
    """Slash path of ``crate::``, ``self::`` and ``super::`` paths seen from a module; item names stay in it."""
    parts = [p for p in module.split("/") if p]
    head, rest = segments[0], segments[1:]
    if head == "crate":
        return "/".join(rest)
    if head == "self":
        return "/".join([*parts, *rest])
    ups = next((i for i, s in enumerate(segments) if s != "super"), len(segments))
    return "/".join([*parts[: max(0, len(parts) - ups)], *segments[ups:]])


def extract(source: str, display: str) -> dict:
    """Facts of one file; one that cannot be parsed has only ``parse_error``."""
    source = source.replace("\r", "")
    facts = empty_facts()
    facts["line_count"] = source.count("\n") + 1
    facts["is_test"] = is_test = is_test_path(display)
    module = module_id(display)
    try:
        items = parse(source)
    except ParseFailure as e:
        facts["parse_error"] = str(e)
        return facts
    starts = [0]
    for line in source.split("\n")[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    line_of = lambda offset: bisect.bisect_right(starts, offset)
    exports, counters = facts["exports"], {"unsafe_blocks": 0, "unwrap_expect": 0}

    def count(attributes, wanted: str, into: dict, last_only: bool) -> None:
        for path, arguments in attributes:
            if path == wanted:
                for argument in arguments:
                    name = argument.split("=")[0]
                    if wanted == "derive" or "(" not in name:
                        name = name.split("::")[-1] if last_only else name
                        into[name] = into.get(name, 0) + 1

    def audit(node: Node) -> None:
        for n in node.walk():
            if n.kind == "Str" and (found := audit_literal(n.value, "literal")):
                facts["findings"].append(finding("secret", found[0], line_of(n.start), "", found[1]))

    def add_function(node: Node, parent: str | None, is_method: bool) -> None:
        first = line_of(node.keyword)
        last = line_of(node.body.end - 1) if node.body else line_of(node.name_end - 1)
        m = metrics(node.body) if node.body else {"complexity": 1, "cognitive": 0, "nesting": 0, "unsafe_blocks": 0, "unwrap_expect": 0}
        for key in counters:
            counters[key] += m[key]
        if node.body:
            audit(node.body)
        facts["functions"].append(
            {
                "name": node.name, "qualname": f"{parent}::{node.name}" if parent else node.name, "line": first, "end_line": last, "line_count": max(0, last - first) + 1,
                "complexity": m["complexity"], "cognitive": m["cognitive"], "nesting": m["nesting"], "params": node.inputs - (is_method and node.receiver), "clone_hash": digest(shape(node.body)) if node.body else digest(""),
                "is_test": is_test, "is_method": is_method, "is_unsafe": node.is_unsafe, "is_async": node.is_async, "visibility": node.visibility, "parent_type": parent,
            }
        )

    def add(item: Node) -> None:
        kind, public = item.kind, item.visibility == "pub"
        count(item.attributes or (), "allow", facts["allow_lints"], False)
        count(item.attributes or (), "derive", facts["derives"], True)
        if kind in ("Fn", "Struct", "Enum", "Trait", "Const", "Static", "Type") and public:
            exports.append(item.name)
        if kind == "Fn":
            add_function(item, None, False)
        elif kind in ("Struct", "Enum"):
            # type attributes are collected once as an item's and once as a type's
            count(item.attributes, "derive", facts["derives"], True)
            count(item.attributes, "allow", facts["allow_lints"], False)
            own: dict[str, int] = {}
            count(item.attributes, "derive", own, True)
            first = line_of(item.keyword)
            last = line_of(item.fields_end - 1) if item.fields_end else 1
            facts["types"].append(
                {"name": item.name, "kind": kind.lower(), "line": first, "line_count": max(0, last - first) + 1, "fields": item.fields, "methods": 0, "derives": sorted(own), "has_generics": item.generic, "visibility": item.visibility}
            )
        elif kind == "Trait":
            facts["traits"].append({"name": item.name, "line": line_of(item.keyword), "visibility": item.visibility})
        elif kind == "Impl" and item.parent:
            for member in item.kids:
                if member.kind == "Fn" and member.body:
                    count(member.attributes, "allow", facts["allow_lints"], False)
                    if member.visibility == "pub":
                        exports.append(f"{item.parent}::{member.name}")
                    add_function(member, item.parent, True)
        elif kind == "Mod":
            for inner in item.kids:
                add(inner)
        elif kind in ("Const", "Static") and item.expr:
            audit(item.expr)
            m = metrics(item.expr)
            for key in counters:
                counters[key] += m[key]
        elif kind == "Use":
            line = line_of(item.start)
            for path, bound in item.tree:
                prefix = path if bound is None else path[:-1]
                internal = bool(prefix) and prefix[0] in ("crate", "self", "super")
                target = resolve(module, path) if internal else "/".join(prefix)
                facts["imports"].append({"source": "::".join(path), "target": target, "specifiers": [bound or "*"], "is_internal": internal, "line": line})
                if public:
                    exports.append(bound or "*")

    for item in items:
        add(item)
    first_of: dict[str, dict] = {}
    for t in facts["types"]:
        first_of.setdefault(t["name"], t)
    for f in facts["functions"]:
        if f["parent_type"] in first_of:
            first_of[f["parent_type"]]["methods"] += 1
    facts["counters"] = {k: n for k, n in counters.items() if n}
    return facts
