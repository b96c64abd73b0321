"""Facts of one TypeScript or JavaScript file."""

from __future__ import annotations

import bisect
import posixpath
import re

from .common import Node, ParseFailure, audit_literal, digest, empty_facts, exact_digest, finding
from .script_parser import parse, unescape

_LOOPS = frozenset("ForStatement ForInStatement ForOfStatement WhileStatement DoWhileStatement".split())
_NESTS = _LOOPS | {"IfStatement", "TryStatement", "CatchClause", "SwitchStatement"}
_DECIDES = _LOOPS | {"IfStatement", "ConditionalExpression", "CatchClause", "LogicalExpression"}
#: Node kinds that a shape keeps; for-variants and while-variants are one each.
_SHAPES = {k: k for k in "IfStatement ReturnStatement TryStatement CatchClause SwitchStatement SwitchCase BreakStatement ContinueStatement ThrowStatement VariableDeclaration ExpressionStatement StringLiteral NumericLiteral BooleanLiteral NullLiteral Identifier CallExpression StaticMember ComputedMember LogicalExpression ConditionalExpression ObjectExpression ArrayExpression AssignmentExpression UpdateExpression AwaitExpression YieldExpression UnaryExpression BinaryExpression TemplateLiteral ArrowFunctionExpression".split()}
_SHAPES |= {"ForStatement": "For", "ForInStatement": "For", "ForOfStatement": "For", "WhileStatement": "While", "DoWhileStatement": "While"}
#: Method names that the ORM case check never reports (fixed value).
ORM_IGNORED = ("toISOString", "getTime", "valueOf", "toString", "hasOwnProperty", "toLowerCase", "toUpperCase", "startsWith", "endsWith", "replaceAll")
_CAMEL = re.compile(r"\.([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)\b")
_HOOK = re.compile(r"use[A-Z]")
_EXTENSION = re.compile(r"\.(?:tsx|ts|jsx|js)$")


def metrics(body: Node) -> dict:
    """Complexity, cognitive score, nesting, shape, hooks and JSX of a function's body, in one walk."""
    complexity, score, deepest, tags, hooks, jsx = 1, 0, 0, [], [], False
    todo: list[tuple[Node, int, int]] = [(body, 0, 0)]  # node, weight depth, nesting depth
    while todo:
        node, depth, nest = todo.pop()
        kind = node.kind
        if kind in _DECIDES or kind == "SwitchCase" and node.test is not None:
            complexity += 1
        if kind in _NESTS:
            nest += 1
            deepest = max(deepest, nest)
        if kind == "LogicalExpression" or kind == "SwitchCase" and node.test is not None:
            score += 1 + depth
        elif kind in _NESTS or kind == "ConditionalExpression":
            if kind != "SwitchStatement":
                score += 1 + depth
            depth += 1
        if kind in _SHAPES:
            tags.append(_SHAPES[kind])
        if kind == "CallExpression":
            name = _callee_name(node.callee)
            if name and len(name) > 3 and _HOOK.match(name) and name not in hooks:
                hooks.append(name)
        elif kind in ("JSXElement", "JSXFragment"):
            jsx = True
        todo.extend((kid, depth, nest) for kid in reversed(node.kids))
    return {"complexity": complexity, "cognitive": score, "nesting": deepest, "shape": "|".join(tags), "hooks": hooks, "jsx": jsx}


def _callee_name(callee: Node) -> str | None:
    return callee.name if callee.kind in ("Identifier", "StaticMember") else None


def is_component_name(name: str) -> bool:
    return "A" <= name[:1] <= "Z" and not name.endswith("Provider")


def component_props(params: Node) -> list[str]:
    """Names that a component destructures from its first parameter, or that parameter's named type."""
    if not params.items:
        return []
    target, annotation = params.items[0]
    if target.kind == "ObjectPattern":
        return [name for _, name in target.properties if name]
    if target.kind == "BindingIdentifier" and annotation is not None and annotation.kind == "TSTypeReference" and annotation.name:
        return [f"[type: {annotation.name}]"]
    return []


def is_test_path(display: str) -> bool:
    return "/__tests__/" in display or any(m in display for m in (".test.", ".spec.", ".cy.", ".jest.")) or display.endswith(("_test.ts", "_test.tsx", "_test.js", "_test.jsx"))


def module_id(path: str) -> str:
    """A module's id: no extension, no trailing /index."""
    return _EXTENSION.sub("", path.replace("\\", "/"), count=1).removesuffix("/index")


def resolve(source: str, below_root: str, alias: str) -> tuple[bool, str]:
    """(internal, path): aliases lose their prefix, relative paths are collapsed and never leave the root."""
    if alias and source.startswith(alias):
        return True, source[len(alias) :]
    if not source.startswith("."):
        return False, source
    parts: list[str] = []
    for part in posixpath.join(posixpath.dirname(below_root), source).replace("\\", "/").split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    return True, "/".join(parts)


def extract(source: str, display: str, below_root: str, alias: str = "@/", orm_methods: tuple[str, ...] = ()) -> dict:
    """Facts of one file; a file that cannot be parsed has ``parse_error`` set and is left out of reports."""
    facts = empty_facts()
    lines = source.split("\n")
    facts["line_count"] = max(len(lines) - (lines[-1] == ""), 1)
    facts["is_test"] = is_test = is_test_path(display)
    extension = "." + below_root.rsplit(".", 1)[-1].lower()
    try:
        program = parse(source, extension)
    except ParseFailure as e:
        facts["parse_error"] = str(e)
        return facts
    starts = [0]
    for line in lines[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    line_of = lambda offset: bisect.bisect_right(starts, offset)
    is_jsx_file = extension in (".tsx", ".jsx")
    exports = facts["exports"]

    def add_function(name: str, node: Node, exported: bool) -> None:
        if node.body is None:
            return
        m = metrics(node.body)
        first, last = line_of(node.start), line_of(node.end)
        component = is_jsx_file and is_component_name(name) and m["jsx"]
        items = node.params.items
        facts["functions"].append(
            {
                "name": name, "qualname": name, "line": first, "end_line": last, "line_count": max(0, last - first) + 1, "complexity": m["complexity"], "cognitive": m["cognitive"], "nesting": m["nesting"],
                "params": len(items) - bool(items and items[0][0].name == "this"), "clone_hash": digest(m["shape"]), "exact_hash": exact_digest(source[node.start : node.end]), "is_test": is_test,
                "exported": exported, "is_component": component, "props": component_props(node.params) if component else [], "hooks": m["hooks"] if component else [],
            }
        )
        if exported:
            exports.append(name)

    def add_class(node: Node, exported: bool) -> None:
        name = node.name
        if name is None:
            return
        methods = [m for m in node.members if m.kind == "MethodDefinition"]
        first, last = line_of(node.start), line_of(node.end)
        facts["types"].append(
            {"name": name, "kind": "class", "line": first, "line_count": max(0, last - first) + 1, "methods": len(methods), "properties": sum(m.kind == "PropertyDefinition" for m in node.members), "exported": exported, "has_heritage": bool(node.heritage)}
        )
        for m in methods:
            if m.method in ("method", "constructor") and m.name:
                add_function(m.name, m.value, False)
        if exported:
            exports.append(name)

    def add_variables(node: Node, exported: bool) -> None:
        for declarator in node.kids:
            if declarator.id.kind != "BindingIdentifier":
                continue
            name, init = declarator.id.name, declarator.init
            if init is not None and init.kind in ("ArrowFunctionExpression", "FunctionExpression"):
                add_function(name, init, exported)
            elif exported:
                exports.append(name)

    def add_import(path: str, specifiers: list[str], start: int) -> None:
        internal, resolved = resolve(path, below_root, alias)
        facts["imports"].append({"source": path, "target": resolved, "specifiers": specifiers, "is_internal": internal, "line": line_of(start)})

    def add_declaration(node: Node, exported: bool) -> None:
        if node.kind == "TSDeclare":
            node = node.kids[0]
        if node.kind == "FunctionDeclaration" and node.name:
            add_function(node.name, node, exported)
        elif node.kind == "VariableDeclaration":
            add_variables(node, exported)
        elif node.kind == "ClassDeclaration":
            add_class(node, exported)
        elif exported and node.kind in ("TSTypeAlias", "TSInterface", "TSEnum"):
            exports.append(node.name)

    for node in program.kids:
        if node.kind == "ImportDeclaration":
            add_import(node.source, node.specifiers, node.start)
        elif node.kind == "ExportAll":
            internal, resolved = resolve(node.source, below_root, alias)
            if internal:
                facts["star_sources"].append(resolved)
        elif node.kind == "ExportNamed":
            if node.declaration is not None:
                add_declaration(node.declaration, True)
            exports += [shown for _, shown in node.specifiers]
            if node.source:
                add_import(node.source, [local for local, _ in node.specifiers], node.start)
        elif node.kind == "ExportDefault":
            if node.declaration.kind in ("FunctionDeclaration", "ClassDeclaration"):
                add_declaration(node.declaration, True)
        else:
            add_declaration(node, False)
    facts["star_sources"] += [i["target"] for i in facts["imports"] if i["is_internal"] and any(s.startswith("* as ") for s in i["specifiers"])]
    _findings(program, facts, line_of, orm_methods)
    if is_jsx_file:
        _observer_gaps(program, facts, line_of)
    return facts


def _is_catch(callee: Node) -> bool:
    if callee.kind == "TSNonNull":
        return _is_catch(callee.expression)
    return callee.kind == "StaticMember" and callee.name == "catch"


def _findings(program: Node, facts: dict, line_of, orm_methods: tuple[str, ...]) -> None:
    """Whole-program audits: ``any``, console and debugger, silent catches, ORM strings, secrets."""
    found, n_any = facts["findings"], 0
    for node in program.walk():
        kind = node.kind
        if kind == "TSAny":
            n_any += 1
        elif kind == "DebuggerStatement":
            found.append(finding("console", "debugger", line_of(node.start)))
        elif kind == "TryStatement":
            handler = node.handler
            if handler is not None and not handler.body.kids:
                found.append(finding("silent", "empty catch clause", line_of(handler.start)))
        elif kind == "StringLiteral":
            if secret := audit_literal(node.value, "literal"):
                found.append(finding("secret", secret[0], line_of(node.start), "", secret[1]))
        elif kind == "CallExpression":
            callee = node.callee
            if callee.kind == "StaticMember" and callee.object.kind == "Identifier" and callee.object.name == "console":
                found.append(finding("console", f"console.{callee.name}", line_of(node.start)))
            if len(node.arguments) == 1 and _is_catch(callee):
                handler = node.arguments[0]
                if handler.kind in ("ArrowFunctionExpression", "FunctionExpression") and not handler.expression and handler.body is not None and not handler.body.kids:
                    found.append(finding("silent", ".catch(() => {})" if handler.kind[0] == "A" else ".catch(function() {})", line_of(node.start)))
            if orm_methods and callee.kind == "StaticMember" and callee.name in orm_methods:
                _orm_strings(node, found, line_of)
    if n_any:
        facts["counters"]["any"] = n_any


def _orm_strings(call: Node, found: list[dict], line_of) -> None:
    """camelCase segments in string arguments; a template is read raw and unescaped, so counts twice."""
    for argument in call.arguments:
        texts = [argument.value] if argument.kind == "StringLiteral" else [t for q in argument.quasis for t in (q, unescape(q))] if argument.kind == "TemplateLiteral" else []
        for text in texts:
            for m in _CAMEL.finditer(text):
                if m[1] not in ORM_IGNORED:
                    found.append(finding("orm", m[1], line_of(argument.start), call.callee.name, m[0]))


def _observer_gaps(program: Node, facts: dict, line_of) -> None:
    """Exported components that are not wrapped in observer(), in files that import it."""
    if not any(i["source"] in ("mobx-react", "mobx-react-lite") and any("observer" in s for s in i["specifiers"]) for i in facts["imports"]):
        return
    has_jsx = lambda body: any(n.kind in ("JSXElement", "JSXFragment") for n in body.walk())
    for node in program.kids:
        what = node.declaration if node.kind in ("ExportNamed", "ExportDefault") else None
        if what is None:
            continue
        if what.kind == "FunctionDeclaration" and what.name and what.body is not None:
            if is_component_name(what.name) and has_jsx(what.body):
                facts["findings"].append(finding("mobx", "exported function component not wrapped in observer()", line_of(what.start), what.name))
        elif what.kind == "VariableDeclaration" and node.kind == "ExportNamed":
            for d in what.kids:
                init = d.init
                if d.id.kind == "BindingIdentifier" and init is not None and init.kind in ("ArrowFunctionExpression", "FunctionExpression"):
                    if is_component_name(d.id.name) and init.body is not None and has_jsx(init.body):
                        facts["findings"].append(finding("mobx", "exported component not wrapped in observer()", line_of(d.start), d.id.name))
