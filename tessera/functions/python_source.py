"""Facts of one Python file, from the standard library's parser."""

from __future__ import annotations

import ast
import re
import warnings

from .common import audit_literal, digest, empty_facts, exact_digest, finding

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_WITHS = (ast.With, ast.AsyncWith)
_TRIES = (ast.Try, ast.TryStar)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
#: HTTP methods of route decorators (fixed value).
ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "head", "options")


# --- metrics -------------------------------------------------------------------------------------

_BRANCHES = (ast.If, *_LOOPS, *_WITHS, ast.Assert, ast.ExceptHandler)


def cyclomatic(body: list[ast.stmt]) -> int:
    """1 + branches; a chain of boolean operands counts its operators, a generator 1 + its filters."""
    total = 1
    todo: list[ast.AST] = list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, _BRANCHES):
            total += 1
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        elif isinstance(node, ast.comprehension):
            total += 1 + len(node.ifs)
        if not isinstance(node, ast.pattern):
            todo.extend(ast.iter_child_nodes(node))
    return total


_DEEPER = (ast.If, *_LOOPS, *_WITHS, *_TRIES)


def nesting_depth(body: list[ast.stmt]) -> int:
    """Deepest statement nesting; a handler is one below its try, a match adds nothing."""
    deepest = 0
    todo: list[tuple[ast.AST, int]] = [(s, 0) for s in body]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, (*_DEEPER, ast.ExceptHandler)):
            depth += 1
            deepest = max(deepest, depth)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                todo.append((child, depth))
    return deepest


def cognitive(body: list[ast.stmt]) -> int:
    """Branches weighted by 1 + nesting.

    What each construct costs and how deep its parts lie is a table: (cost, [(part, deeper by)]);
    parts left out (an if's test, a for's target) are not visited at all.
    """
    total = 0
    todo: list[tuple[ast.AST, int]] = [(s, 0) for s in body]
    while todo:
        node, nest = todo.pop()
        cost, parts = _cognitive_parts(node)
        total += cost * (1 + nest)
        todo.extend((child, nest + deeper) for child, deeper in parts)
    return total


def _cognitive_parts(node: ast.AST) -> tuple[int, list[tuple[ast.AST, int]]]:
    def deeper(*groups) -> list[tuple[ast.AST, int]]:
        return [(n, 1) for group in groups for n in (group if isinstance(group, list) else [group])]

    match node:
        case ast.If():
            return 1, deeper(node.body, node.orelse)
        case ast.For() | ast.AsyncFor():
            return 1, deeper(node.iter, node.body, node.orelse)
        case ast.While():
            return 1, deeper(node.test, node.body, node.orelse)
        case ast.With() | ast.AsyncWith():
            bound = [i.optional_vars for i in node.items if i.optional_vars]
            return 1, deeper([i.context_expr for i in node.items], bound, node.body)
        case ast.Match():
            guards = [c.guard for c in node.cases if c.guard]
            return 1, deeper(node.subject, guards, *[c.body for c in node.cases])
        case ast.Try() | ast.TryStar():
            return 0, deeper(node.body, node.orelse, node.finalbody) + [(h, 0) for h in node.handlers]
        case ast.ExceptHandler():
            return 1, deeper([node.type] if node.type else [], node.body)
        case ast.BoolOp():
            return len(node.values) - 1, [(v, 0) for v in node.values]
        case ast.IfExp():
            return 1, [(node.test, 0), *deeper(node.body, node.orelse)]
        case ast.comprehension():
            return 1 + len(node.ifs), [(n, 0) for n in (node.target, node.iter, *node.ifs)]
        case ast.Assert():
            return 1, [(n, 0) for n in ast.iter_child_nodes(node)]
        case ast.ClassDef():
            return 0, [(n, 0) for n in (*node.decorator_list, *node.bases, *node.body)]
    return 0, [(n, 0) for n in ast.iter_child_nodes(node)]


#: Parts that a shape leaves out, by node type: what is there but does not tell structures apart.
_SHAPE_SKIPS = {
    "With": {"items"}, "AsyncWith": {"items"}, "Try": {"handlers"}, "TryStar": {"handlers"}, "Lambda": {"args"}, "AnnAssign": {"annotation"},
    "FunctionDef": {"args", "decorator_list", "returns", "type_params"}, "AsyncFunctionDef": {"args", "decorator_list", "returns", "type_params"},
    "ClassDef": {"decorator_list", "keywords", "type_params"}, "match_case": {"pattern", "guard"}, "Raise": {"cause"}, "FormattedValue": {"format_spec"},
}
_SHAPE_LEAVES = {"Constant": "LIT", "Name": "NAME", "Slice": "EXPR", "TypeAlias": "TYPEALIAS", "Import": "IMPORT", "ImportFrom": "IMPORTFROM"}


def shape(body: list[ast.stmt]) -> str:
    """Pre-order node types: equal for bodies that differ in names, constants and operators only."""
    out: list[str] = []
    todo: list[ast.AST] = list(reversed(body))
    while todo:
        node = todo.pop()
        name = type(node).__name__
        if name in _SHAPE_LEAVES:
            out.append(_SHAPE_LEAVES[name])
            continue
        if isinstance(node, (ast.stmt, ast.expr)):
            out.append(name)
        skipped = _SHAPE_SKIPS.get(name, ())
        values = (value for field, value in ast.iter_fields(node) if field not in skipped)
        kids = [c for v in values for c in (v if isinstance(v, list) else (v,)) if isinstance(c, (ast.stmt, ast.expr, ast.comprehension, ast.keyword, ast.match_case))]
        todo.extend(reversed(kids))
    return "|".join(out)


# --- declarations --------------------------------------------------------------------------------


def count_params(args: ast.arguments, is_method: bool) -> int:
    """Parameters, without a method's leading self or cls."""
    n = len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg)
    if is_method and args.args and args.args[0].arg in ("self", "cls"):
        n -= 1
    return n


def decorator_text(node: ast.expr) -> str:
    return "@" + _source_of(node)


def _source_of(node: ast.expr) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        return "..."


def mutable_defaults(node, qualname: str) -> list[dict]:
    """Defaults that are built once: list, dict and set displays, and any call."""
    args = node.args
    positional = [*args.posonlyargs, *args.args]
    pairs = [*zip(positional[len(positional) - len(args.defaults) :], args.defaults), *zip(args.kwonlyargs, args.kw_defaults)]
    kinds = {ast.List: "list", ast.Dict: "dict", ast.Set: "set", ast.Call: "call"}
    return [finding("mutable_default", kinds[type(d)], d.lineno, qualname, a.arg) for a, d in pairs if type(d) in kinds]


def route(node, qualname: str) -> dict | None:
    """The first decorator that is a call of an HTTP-method attribute."""
    for decorator in node.decorator_list:
        if isinstance(decorator, ast.Call) and isinstance(decorator.func, ast.Attribute) and decorator.func.attr in ROUTE_METHODS:
            first = decorator.args[0] if decorator.args else None
            path = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else ""
            calls = (c for s in node.body for c in ast.walk(s) if isinstance(c, ast.Call))
            depends = [_source_of(c.args[0]) for c in calls if isinstance(c.func, ast.Name) and c.func.id == "Depends" and c.args]
            return {"method": decorator.func.attr.upper(), "path": path, "handler": qualname, "line": node.lineno, "dependencies": depends}
    return None


def silent_handlers(tree: ast.Module) -> list[dict]:
    """Handlers whose only statement is ``pass`` or a bare constant."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler) and len(node.body) == 1:
            only = node.body[0]
            if isinstance(only, ast.Pass):
                out.append(finding("silent", "except: pass", node.lineno))
            elif isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant):
                out.append(finding("silent", "except: <string-only>", node.lineno))
    return sorted(out, key=lambda f: f["line"])


def _target_hint(node: ast.expr) -> str:
    match node:
        case ast.Name():
            return node.id
        case ast.Attribute():
            return f"{_target_hint(node.value)}.{node.attr}"
        case ast.Subscript():
            return f"{_target_hint(node.value)}[]"
        case ast.Tuple():
            return ",".join(map(_target_hint, node.elts))
    return "?"


def secrets(tree: ast.Module) -> list[dict]:
    """String constants assigned directly to something."""
    out = []
    for node in ast.walk(tree):
        target = node.targets[0] if isinstance(node, ast.Assign) else node.target if isinstance(node, ast.AnnAssign) else None
        value = getattr(node, "value", None)
        if target is not None and isinstance(value, ast.Constant) and isinstance(value.value, str):
            if found := audit_literal(value.value, _target_hint(target)):
                out.append(finding("secret", found[0], value.lineno, "", found[1]))
    return out


def resolve_relative(module: str, level: int, name: str | None) -> str:
    """``from ..x import`` seen from ``module``: as many trailing parts go as there are dots, one stays."""
    parts = module.split(".")
    base = parts[: max(1, len(parts) - level)]
    return ".".join([*base, *(name.split(".") if name else [])])


def imports(tree: ast.Module, module: str, package: str) -> tuple[list[dict], list[str]]:
    """Imports of the package itself at module level, and modules imported with a star."""
    own = lambda target: target == package or target.startswith(package + ".")
    rows, stars = [], []

    def add(target: str, names: list[str], line: int) -> None:
        if own(target):
            rows.append({"source": module, "target": target, "specifiers": names, "is_internal": True, "line": line})

    for node in tree.body:
        if isinstance(node, ast.Import):
            for alias in node.names:
                add(alias.name, [alias.asname or alias.name], node.lineno)
        elif isinstance(node, ast.ImportFrom):
            if node.names[0].name == "*":
                if node.module:
                    stars.append(f"{package}.{node.module}" if node.level else node.module)
            if node.module:
                target = resolve_relative(module, node.level, node.module) if node.level else node.module
                add(target, [alias.name for alias in node.names], node.lineno)
    return rows, stars


def is_test_path(display: str) -> bool:
    lower, name = display.lower(), display.rsplit("/", 1)[-1]
    return "/tests/" in lower or lower.startswith("tests/") or name.startswith("test_") and name.endswith(".py") or name.endswith(("_test.py", "_tests.py"))


def module_id(below_root: str, package: str) -> str:
    """Dotted module of a path below the scan root."""
    parts = re.sub(r"\.py$", "", below_root).split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join([package, *parts])


def extract(source: str, display: str, module: str, package: str) -> dict:
    """Facts of one file; a syntax error leaves only its message."""
    source = source.replace("\r", "")
    facts = empty_facts()
    facts["line_count"] = source.count("\n") + 1
    facts["is_test"] = is_test = is_test_path(display)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        facts["parse_error"] = f"{type(e).__name__}: {e}"
        return facts
    lines = source.split("\n")

    def function(node, owner: str | None) -> None:
        qualname = f"{owner}.{node.name}" if owner else node.name
        text = "\n".join([lines[node.lineno - 1].encode()[node.col_offset :].decode(), *lines[node.lineno : node.end_lineno]])
        facts["functions"].append(
            {
                "name": node.name, "qualname": qualname, "line": node.lineno, "end_line": node.end_lineno, "line_count": max(0, node.end_lineno - node.lineno) + 1,
                "complexity": cyclomatic(node.body), "cognitive": cognitive(node.body), "nesting": nesting_depth(node.body), "params": count_params(node.args, owner is not None),
                "clone_hash": digest(shape(node.body)), "exact_hash": exact_digest(text), "is_test": is_test, "is_method": owner is not None,
                "decorators": [decorator_text(d) for d in node.decorator_list],
            }
        )
        facts["findings"] += mutable_defaults(node, qualname)
        if found := route(node, qualname):
            facts["routes"].append(found)

    exports = facts["exports"]
    for node in tree.body:
        if isinstance(node, _FUNCTIONS):
            function(node, None)
            exports.append(node.name)
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, _FUNCTIONS)]
            for m in methods:
                function(m, node.name)
            facts["types"].append(
                {"name": node.name, "kind": "class", "line": node.lineno, "line_count": max(0, node.end_lineno - node.lineno) + 1, "methods": len(methods), "decorators": [decorator_text(d) for d in node.decorator_list]}
            )
            exports.append(node.name)
        elif isinstance(node, ast.Assign):
            exports += [t.id for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            exports.append(node.target.id)
    facts["imports"], facts["star_sources"] = imports(tree, module, package)
    facts["findings"] += silent_handlers(tree) + secrets(tree)
    return facts
