"""A parser for Rust source: items, and the expression structure that metrics need.

Patterns, types and macro bodies are skipped as balanced tokens.  Trees are
:class:`~tessera.functions.common.Node` values with children in source order.
"""

from __future__ import annotations

import re

from .common import Node, ParseFailure

_TOKEN = re.compile(
    r"""(?P<space>\s+|//(?!/(?!/)|!)[^\n]*)
    |(?P<doc>///[^\n]*|//![^\n]*)
    |(?P<comment>/\*)
    |(?P<str>(?:b|c)?"(?:[^"\\]|\\[\s\S])*")
    |(?P<raw>(?:b|c)?r(?P<hashes>\#*)"[\s\S]*?"(?P=hashes))
    |(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')
    |(?P<life>'[^\W\d]\w*)
    |(?P<name>(?:r\#)?[^\W\d]\w*)
    |(?P<num>0[xX][\da-fA-F_]+\w*|0[oO][0-7_]+\w*|0[bB][01_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*)
    |(?P<punct>\.\.\.|\.\.=|\.\.|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|[{}()\[\];,<>+\-*/%&|^!~?:=.@\#$])""",
    re.VERBOSE,
)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u\{([0-9a-fA-F_]+)\}|\n\s*|(.))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_OPEN = {"(": ")", "[": "]", "{": "}"}

# The binding powers of Rust's binary operators.
POWER = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "|": 4, "^": 5, "&": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
BLOCK_LIKE = frozenset("If Match While For Loop Block Unsafe ConstBlock".split())
KEYWORDS = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())


def unescape(body: str) -> str:
    if "\\" not in body:
        return body
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2].replace("_", ""), 16)) if m[2] else _SIMPLE.get(m[3], m[3]) if m[3] else "", body)


def tokenize(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of every token; comments are dropped, outer doc comments kept as ``doc``."""
    out, at, n = [], 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseFailure(f"unexpected character at {at}")
        kind = m.lastgroup if m.lastgroup != "hashes" else "raw"
        if kind == "comment":
            depth, end = 1, at + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, end)
                if not m:
                    raise ParseFailure("unterminated comment")
                depth, end = depth + (1 if m[0] == "/*" else -1), m.end()
            if text.startswith("/**", at) and not text.startswith(("/***", "/**/"), at):
                out.append(("doc", "", at, end))
            at = end
            continue
        if kind == "doc" and m[0].startswith("//!"):
            kind = "space"
        if kind != "space":
            out.append((kind, m[0], at, m.end()))
        at = m.end()
    out.append(("eof", "", n, n))
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokenize(text), 0
        self.no_struct = False
        self.match: dict[int, int] = {}
        stack = []
        for k, (kind, value, _, _) in enumerate(self.tokens):
            if kind == "punct":
                if value in _OPEN:
                    stack.append(k)
                elif value in (")", "]", "}"):
                    if not stack or _OPEN[self.tokens[stack[-1]][1]] != value:
                        raise ParseFailure(f"unbalanced {value}")
                    self.match[stack.pop()] = k
        if stack:
            raise ParseFailure("unclosed delimiter")

    # --- tokens ---

    @property
    def value(self) -> str:
        kind, value, _, _ = self.tokens[self.i]
        return value if kind in ("punct", "name") else ""

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def start(self) -> int:
        return self.tokens[self.i][2]

    @property
    def end(self) -> int:
        return self.tokens[self.i - 1][3] if self.i else 0

    def ahead(self, n: int = 1) -> str:
        k = min(self.i + n, len(self.tokens) - 1)
        return self.tokens[k][1] if self.tokens[k][0] in ("punct", "name") else ""

    def next(self) -> str:
        if self.tokens[self.i][0] == "eof":
            self.fail("unexpected end")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def take(self, *values: str) -> bool:
        if self.value and self.value in values:
            self.i += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value}")

    def fail(self, what: str = "unexpected token"):
        raise ParseFailure(f"{what} at {self.start}, found {self.tokens[self.i][1][:20]!r}")

    def name(self) -> str:
        if self.kind != "name":
            self.fail("expected a name")
        return self.next().removeprefix("r#")

    def joined(self, *values: str) -> bool:
        """Whether the next tokens are ``values`` without space between them."""
        for k, v in enumerate(values):
            t = self.tokens[min(self.i + k, len(self.tokens) - 1)]
            if t[1] != v or k and t[2] != self.tokens[self.i + k - 1][3]:
                return False
        return True

    def skip_tree(self) -> tuple[int, int]:
        """Step over a delimited group; (first, last) inner token positions."""
        if self.i not in self.match:
            self.fail("expected a group")
        first, last = self.i + 1, self.match[self.i]
        self.i = last + 1
        return first, last

    def skip_angles(self) -> None:
        """Step over ``<...>``."""
        self.expect("<")
        depth = 1
        while depth:
            if self.kind == "eof":
                self.fail("expected >")
            if self.i in self.match:
                self.skip_tree()
                continue
            value = self.next()
            if value == "<":
                depth += 1
            elif value == ">":
                depth -= 1
            elif value == ">=" and depth:
                depth -= 1
                if depth == 0:
                    self.fail("unexpected >=")

    # --- attributes, types, patterns ---

    def attributes(self) -> list[tuple[str, list[str]]]:
        """(path, argument paths) of outer and inner attributes here; doc comments are attributes without a name."""
        out = []
        while True:
            if self.kind == "doc":
                self.i += 1
                out.append(("doc", []))
            elif self.value == "#" and (self.ahead() == "[" or self.ahead() == "!" and self.ahead(2) == "["):
                self.i += 1
                self.take("!")
                first, last = self.skip_tree()
                out.append(self._attribute(first, last))
            else:
                return out

    def _attribute(self, first: int, last: int) -> tuple[str, list[str]]:
        values = [t[1] for t in self.tokens[first:last]]
        path = values[0] if values else ""
        if len(values) < 2 or values[1] != "(":
            return path, []
        arguments, now, depth = [], [], 0
        for v in [*values[2 : self.match[first + 1] - first], ","]:
            depth += (v in "([{<") - (v in ")]}>") if len(v) == 1 else 0
            if v == "," and depth == 0:
                if now:
                    arguments.append("".join(now))
                now = []
            else:
                now.append(v)
        return path, arguments

    def visibility(self) -> str:
        if not self.take("pub"):
            return ""
        if self.value == "(" and self.ahead() in ("crate", "self", "super", "in"):
            first, last = self.skip_tree()
            path = [t[1] for t in self.tokens[first:last] if t[1] not in ("in", "::")]
            return f"pub({'::'.join(path)})"
        return "pub"

    def type_(self, plus: bool = True) -> None:
        """Step over a type."""
        if self.take("&", "&&"):
            if self.kind == "life":
                self.i += 1
            self.take("mut")
            return self.type_(False)
        if self.take("*"):
            self.next()
            return self.type_(False)
        if self.value in ("(", "["):
            self.skip_tree()
        elif self.take("!", "_"):
            pass
        elif self.take("impl", "dyn"):
            self.bounds()
        elif self.take("for"):
            self.skip_angles()
            return self.type_(plus)
        elif self.value in ("unsafe", "extern", "fn"):
            self.take("unsafe")
            if self.take("extern") and self.kind in ("str", "raw"):
                self.i += 1
            self.expect("fn")
            self.skip_tree()
            if self.take("->"):
                self.type_(False)
        elif self.kind == "name" and self.value == "typeof":
            self.i += 1
            self.skip_tree()
        elif self.kind == "life":
            self.i += 1
        else:
            self.type_path()
            if self.take("!"):
                self.skip_tree()
        if plus:
            while self.take("+"):
                self.bound()

    def bounds(self) -> None:
        self.bound()
        while self.take("+"):
            self.bound()

    def bound(self) -> None:
        if self.kind == "life":
            self.i += 1
        elif self.value == "(":
            self.skip_tree()
        else:
            self.take("?", "~")
            self.take("const", "async")
            if self.take("for"):
                self.skip_angles()
            if self.value == "use" and self.ahead() == "<":
                self.i += 1
                return self.skip_angles()
            self.type_path()

    def type_path(self) -> str:
        """Step over a path in type position; its last name."""
        last = ""
        if self.value == "<":
            self.skip_angles()
            self.expect("::")
        self.take("::")
        while True:
            if self.value == "$":
                self.i += 1
            last = self.name()
            if self.value == "::" and self.ahead() == "<":
                self.i += 1
            if self.value == "<":
                self.skip_angles()
            elif self.value == "(" and last.startswith("Fn"):
                self.skip_tree()
                if self.take("->"):
                    self.type_(False)
            if self.value == "::" and self.tokens[self.i + 1][0] == "name":
                self.i += 1
                continue
            return last

    def pattern(self, *stops: str) -> None:
        """Step over a pattern up to one of ``stops`` outside any group."""
        first = self.i
        while self.value not in stops or not self.value:
            if self.kind == "eof" or self.value in (")", "]", "}"):
                self.fail("expected " + " or ".join(stops))
            if self.i in self.match:
                self.skip_tree()
            elif self.value == "<" or self.value == "::" and self.ahead() == "<":
                self.take("::")
                self.skip_angles()
            else:
                self.i += 1
        if self.i == first:
            self.fail("expected a pattern")

    def generics(self) -> bool:
        """Step over generic parameters; whether there are any."""
        if self.value != "<":
            return False
        first = self.i
        self.skip_angles()
        return self.i > first + 2

    def where(self) -> None:
        if self.value != "where":
            return
        while self.value not in ("{", ";", "=") and self.kind != "eof":
            self.skip_tree() if self.i in self.match else self.next()

    # --- items ---

    def file(self) -> list[Node]:
        items = []
        while self.kind != "eof":
            mark = self.i
            if self.value == "#" and self.ahead() == "!":
                self.attributes()
                if self.i == mark:
                    self.fail()
                continue
            items.append(self.item())
        return items

    def item(self) -> Node:
        start = self.start
        attributes = self.attributes()
        if self.kind == "eof" and attributes:
            return Node("Empty", start, start)
        visibility = self.visibility()
        node = self._item(start)
        if node is None:
            self.fail("expected an item")
        node.parts |= {"attributes": attributes, "visibility": visibility}
        return node

    def _item(self, start: int) -> Node | None:
        at, word = self.start, self.value
        if word == "use":
            self.i += 1
            tree = self.use_tree()
            self.expect(";")
            return Node("Use", start, self.end, tree=tree)
        if word in ("struct", "union") and self.tokens[self.i + 1][0] == "name":
            return self.struct(start, at)
        if word == "enum":
            return self.enum(start, at)
        if word in ("trait", "auto") or word == "unsafe" and self.ahead() in ("trait", "auto"):
            return self.trait(start)
        if word == "impl" or word in ("unsafe", "default") and self.ahead() == "impl":
            return self.impl(start)
        if word == "mod" or word == "unsafe" and self.ahead() == "mod":
            self.take("unsafe")
            self.i += 1
            name, items = self.name(), None
            if not self.take(";"):
                self.expect("{")
                items = []
                while not self.take("}"):
                    items.append(self.item())
            return Node("Mod", start, self.end, items or [], name=name)
        if word == "type":
            self.i += 1
            name = self.name()
            self._to_semicolon()
            return Node("Type", start, self.end, name=name)
        if word == "static" or word == "const" and self.ahead() not in ("fn", "unsafe", "async", "extern", "{", "move", "|", "||"):
            self.i += 1
            self.take("mut")
            name, expr = self.name(), None
            self.generics()
            if self.take(":"):
                self.type_()
            if self.take("="):
                expr = self.expression()
            self.where()
            self.expect(";")
            return Node("Const" if word == "const" else "Static", start, self.end, [expr] if expr else [], name=name, expr=expr)
        if word == "extern" and self.ahead() == "crate":
            self._to_semicolon()
            return Node("ExternCrate", start, self.end)
        if word == "extern" and (self.ahead() == "{" or self.tokens[self.i + 1][0] in ("str", "raw") and self.ahead(2) == "{") or word == "unsafe" and self.ahead() == "extern" and (self.ahead(2) == "{" or self.ahead(3) == "{"):
            while self.value != "{":
                self.i += 1
            self.skip_tree()
            return Node("Foreign", start, self.end)
        if word in ("fn", "const", "async", "unsafe", "extern", "default", "safe"):
            k = 0
            while self.ahead(k) in ("const", "async", "unsafe", "extern", "default", "safe") or self.tokens[self.i + k][0] in ("str", "raw"):
                k += 1
            if self.ahead(k) == "fn":
                return self.function(start)
            return None
        if word == "macro_rules" and self.ahead() == "!":
            self.i += 2
            self.name()
            braces = self.value == "{"
            self.skip_tree()
            if not braces:
                self.take(";")
            return Node("Macro", start, self.end)
        if self.kind == "name" and word not in KEYWORDS - {"crate", "self", "super"} or word == "::":
            k = self.i
            self.type_path_plain()
            if self.take("!"):
                if self.kind == "name":
                    self.i += 1
                braces = self.value == "{"
                self.skip_tree()
                if not braces:
                    self.expect(";")
                return Node("Macro", start, self.end)
            self.i = k
        if word == ";":
            self.i += 1
            return Node("Empty", start, self.end)
        return None

    def type_path_plain(self) -> None:
        self.take("::")
        self.name()
        while self.value == "::" and self.tokens[self.i + 1][0] == "name":
            self.i += 2

    def _to_semicolon(self) -> None:
        while not self.take(";"):
            self.skip_tree() if self.i in self.match else self.next()

    def use_tree(self) -> list[tuple[list[str], str | None]]:
        """Leaves as (path segments, name it is bound to; None for a glob)."""
        self.take("::")
        if self.take("*"):
            return [([], None)]
        if self.take("{"):
            leaves = []
            while not self.take("}"):
                leaves += self.use_tree()
                if not self.take(","):
                    self.expect("}")
                    break
            return leaves
        segment = self.name()
        if self.take("::"):
            return [([segment, *path], bound) for path, bound in self.use_tree()]
        if self.take("as"):
            return [([segment], self.next())]
        return [([segment], segment)]

    def struct(self, start: int, at: int) -> Node:
        self.i += 1
        name, generic = self.name(), False
        generic = self.generics()
        self.where()
        fields, stop = 0, None
        if self.value == "(":
            fields, stop = self._count_list()
            self.where()
            self.expect(";")
        elif self.value == "{":
            fields, stop = self._count_list()
        else:
            self.expect(";")
        return Node("Struct", start, self.end, name=name, keyword=at, fields=fields, fields_end=stop, generic=generic)

    def _count_list(self) -> tuple[int, int]:
        """Comma-separated parts of the group here (angle brackets respected), and where the group ends."""
        first, last = self.skip_tree()
        n, depth, filled, k = 0, 0, False, first
        while k < last:
            value = self.tokens[k][1]
            if k in self.match:
                filled, k = True, self.match[k] + 1
                continue
            if value == "<":
                depth += 1
            elif value == ">":
                depth -= 1
            if value == "," and depth == 0:
                n, filled = n + filled, False
            elif self.tokens[k][0] != "doc":
                filled = True
            k += 1
        return n + filled, self.tokens[last][3]

    def enum(self, start: int, at: int) -> Node:
        self.i += 1
        name = self.name()
        generic = self.generics()
        self.where()
        first, last = self.i + 1, self.match.get(self.i)
        variants, _ = self._count_list()
        stop = self.tokens[last - 1][3] if last > first else None
        return Node("Enum", start, self.end, name=name, keyword=at, fields=variants, fields_end=stop, generic=generic)

    def trait(self, start: int) -> Node:
        while self.value in ("unsafe", "auto"):
            self.i += 1
        at = self.start
        self.expect("trait")
        name, kids = self.name(), []
        self.generics()
        if self.take(":"):
            while self.value not in ("{", "where", "="):
                self.skip_tree() if self.i in self.match else self.next()
        self.where()
        if self.take("="):
            self._to_semicolon()
        else:
            self.expect("{")
            while not self.take("}"):
                kids.append(self.item())
        return Node("Trait", start, self.end, kids, name=name, keyword=at)

    def impl(self, start: int) -> Node:
        while self.value != "impl":
            self.i += 1
        self.i += 1
        if self.value == "<":
            self.skip_angles()
        self.take("const")
        self.take("!")
        parent, kids = self._self_type(), []
        if self.take("for"):
            parent = self._self_type()
        self.where()
        self.expect("{")
        while not self.take("}"):
            kids.append(self.item())
        return Node("Impl", start, self.end, kids, parent=parent)

    def _self_type(self) -> str | None:
        """The last name of a path type; None for other types."""
        plain = self.kind == "name" and self.value not in ("dyn", "impl", "fn", "unsafe", "extern", "for") or self.value in ("::", "<")
        if plain:
            last = self.type_path()
            if self.take("!"):
                self.skip_tree()
                return None
            return last
        self.type_()
        return None

    def function(self, start: int) -> Node:
        words = set()
        while self.value != "fn":
            words.add(self.value)
            self.i += 1
        at = self.start
        self.i += 1
        name = self.name()
        name_end = self.end
        self.generics()
        if self.value != "(":
            self.fail("expected (")
        open_ = self.i
        receiver = self._has_receiver(open_)
        inputs, _ = self._count_list()
        if self.take("->"):
            self.type_()
        self.where()
        body = None
        if not self.take(";"):
            body = self.block()
        return Node("Fn", start, self.end, [body] if body else [], name=name, keyword=at, name_end=name_end, inputs=inputs, receiver=receiver, body=body, is_unsafe="unsafe" in words, is_async="async" in words)

    def _has_receiver(self, open_: int) -> bool:
        k, last = open_ + 1, self.match[open_]
        while k < last and (self.tokens[k][1] in ("&", "mut") or self.tokens[k][0] in ("life", "doc")):
            k += 1
        return self.tokens[k][1] == "self" and k < last

    # --- statements and expressions ---

    def block(self) -> Node:
        start = self.start
        self.expect("{")
        held, self.no_struct = self.no_struct, False
        kids = []
        while not self.take("}"):
            if kid := self.statement():
                kids.append(kid)
        self.no_struct = held
        return Node("Block", start, self.end, kids)

    def statement(self) -> Node | None:
        if self.take(";"):
            return None
        mark = self.i
        start = self.start
        self.attributes()
        if self.value == "}":
            return None
        if self.value == "let":
            self.i += 1
            kids = []
            self.pattern(":", "=", ";")
            if self.take(":"):
                self.type_()
            if self.take("="):
                kids.append(self.expression())
                if self.take("else"):
                    kids.append(self.block())
            self.expect(";")
            return Node("Let", start, self.end, kids)
        if self._starts_item():
            self.i = mark
            return self.item()
        expr = self.expression(statement=True)
        if self.take(";"):
            return Node("Semi", start, self.end, [expr])
        if self.value != "}" and expr.kind not in BLOCK_LIKE and not (expr.kind == "Macro" and expr.braces):
            self.fail("expected ;")
        return expr

    def _starts_item(self) -> bool:
        word, after = self.value, self.ahead()
        if word in ("use", "enum", "trait", "impl", "mod", "type", "static", "fn", "pub", "extern"):
            return not (word == "static" and after in ("|", "||", "move"))
        if word == "struct" or word == "union" and self.tokens[self.i + 1][0] == "name" and after not in KEYWORDS:
            return True
        if word == "macro_rules" and after == "!":
            return True
        if word == "const":
            return after not in ("{", "|", "||", "move", "async") or after == "async" and self.ahead(2) == "fn"
        if word == "unsafe":
            return after in ("fn", "impl", "trait", "extern", "mod")
        return word == "async" and (after == "fn" or after == "unsafe")

    def condition(self) -> Node:
        held, self.no_struct = self.no_struct, True
        expr = self.expression()
        self.no_struct = held
        return expr

    def expression(self, statement: bool = False) -> Node:
        start = self.start
        self.attributes()
        if self.value in ("..", "..="):
            return self._range(start, None)
        left = self.binary(0, statement)
        if statement and left.kind in BLOCK_LIKE and left.parts.get("closed"):
            return left
        if self.value in ("..", "..=", "..."):
            left = self._range(start, left)
        op = self.value if self.value in ASSIGN else "<<=" if self.joined("<", "<=") else ">>=" if self.joined(">", ">=") else None
        if op:
            self.i += 2 if op in ("<<=", ">>=") else 1
            return Node("Assign", start, self.end, [left, self.expression()], op=op)
        return left

    def _range(self, start: int, left: Node | None) -> Node:
        self.i += 1
        kids = [left] if left else []
        if self._starts_expression():
            kids.append(self.binary(0))
        return Node("Range", start, self.end, kids)

    def _starts_expression(self) -> bool:
        if self.kind == "eof" or self.kind == "punct" and self.value in (")", "]", "}", ",", ";", "=>", "=", ".", "?", ":", "->", "@"):
            return False
        if self.value == "{" and self.no_struct:
            return False
        return self.value not in ("else", "as", "in", "where")

    def operator(self) -> str | None:
        value = self.value
        if value == "<" and self.joined("<", "<"):
            return "<<"
        if value == ">" and self.joined(">", ">"):
            return ">>"
        if value in ("<", ">") and (self.joined("<", "<=") or self.joined(">", ">=")):
            return None
        return value if value in POWER else None

    def binary(self, least: int, statement: bool = False) -> Node:
        start, left = self.start, self.unary(statement)
        if statement and left.kind in BLOCK_LIKE and left.parts.get("closed"):
            return left
        while True:
            if self.value == "as":
                self.i += 1
                self._cast_type()
                left = Node("Cast", start, self.end, [left])
                continue
            op = self.operator()
            if op is None or POWER[op] <= least:
                return left
            self.i += 2 if op in ("<<", ">>") else 1
            left = Node("Binary", start, self.end, [left, self.binary(POWER[op])], op=op)

    def _cast_type(self) -> None:
        if self.kind == "name" and self.value not in ("dyn", "impl", "fn", "unsafe", "extern", "for"):
            # ``a as usize < b`` compares; generic arguments need a closing bracket before the statement ends
            self.take("::")
            self.name()
            while self.value == "::" and self.tokens[self.i + 1][0] == "name":
                self.i += 2
            if self.value == "<" and self.ahead() not in ("", "<") and self.ahead(2) in (">", ",", "::", "<"):
                mark = self.i
                try:
                    self.skip_angles()
                except ParseFailure:
                    self.i = mark
            return
        self.type_(False)

    def unary(self, statement: bool = False) -> Node:
        start, value = self.start, self.value
        if value in ("-", "!", "*"):
            self.i += 1
            return Node("Unary", start, self.end, [self.unary()])
        if value in ("&", "&&"):
            self.i += 1
            if self.value == "raw" and self.ahead() in ("const", "mut"):
                self.i += 2
            else:
                self.take("mut")
            return Node("Reference", start, self.end, [self.unary()])
        if value == "let":
            self.i += 1
            self.pattern("=")
            self.i += 1
            return Node("LetCondition", start, self.end, [self.binary(2)])
        return self.postfix(self.primary(), statement)

    def arguments(self) -> list[Node]:
        """Comma-separated expressions in the group here."""
        close = self.match[self.i]
        self.i += 1
        held, self.no_struct = self.no_struct, False
        out = []
        while self.i < close:
            out.append(self.expression())
            if self.i < close and not self.take(",", ";"):
                self.fail("expected ,")
        self.no_struct = held
        self.i = close + 1
        return out

    def postfix(self, expr: Node, statement: bool = False) -> Node:
        start = expr.start
        if statement and expr.kind in BLOCK_LIKE and self.value not in (".", "?"):
            expr.parts["closed"] = True
            return expr
        while True:
            if self.take("?"):
                expr = Node("Try", start, self.end, [expr])
            elif self.value == "." and self.kind == "punct":
                self.i += 1
                if self.take("await"):
                    expr = Node("Await", start, self.end, [expr])
                elif self.kind == "num":
                    self.i += 1
                    expr = Node("Field", start, self.end, [expr])
                else:
                    name = self.name()
                    if self.value == "::":
                        self.i += 1
                        self.skip_angles()
                    if self.value == "(":
                        expr = Node("MethodCall", start, 0, [expr, *self.arguments()], name=name)
                        expr.end = self.end
                    else:
                        expr = Node("Field", start, self.end, [expr])
            elif self.value == "(":
                expr = Node("Call", start, 0, [expr, *self.arguments()])
                expr.end = self.end
            elif self.value == "[":
                expr = Node("Index", start, 0, [expr, *self.arguments()])
                expr.end = self.end
            else:
                return expr

    def primary(self) -> Node:
        start, kind, value = self.start, self.kind, self.value
        if kind == "life":
            self.i += 1
            self.expect(":")
            return self.primary()
        if kind in ("str", "raw", "char", "num"):
            raw = self.next()
            if kind in ("str", "raw") and raw[0] in "\"r":
                body = raw[1:-1] if kind == "str" else raw.lstrip("r").strip("#")[1:-1]
                return Node("Str", start, self.end, value=unescape(body) if kind == "str" else body)
            return Node("Literal", start, self.end)
        if value == "(":
            close = self.match[self.i]
            inner = self.arguments()
            comma = self.tokens[close - 1][1] == ","
            return Node("Paren" if len(inner) == 1 and not comma else "Tuple", start, self.end, inner)
        if value == "[":
            return Node("Array", start, self.tokens[self.match[self.i]][3], self.arguments())
        if value == "{":
            return self.block()
        if value in ("|", "||") or value in ("move", "static") or value == "async" and self.ahead() in ("|", "||") or value == "async" and self.ahead() == "move" and self.ahead(2) in ("|", "||"):
            return self.closure(start)
        rule = getattr(self, f"_{value}", None) if value in _EXPRESSIONS else None
        if rule:
            return rule(start)
        if value in ("true", "false", "_"):
            self.i += 1
            return Node("Literal", start, self.end)
        if kind == "name" and value not in KEYWORDS - {"crate", "self", "Self", "super"} or value in ("::", "<", "$"):
            return self.path(start)
        self.fail("expected an expression")

    def path(self, start: int) -> Node:
        if self.value == "<":
            self.skip_angles()
            self.expect("::")
        self.take("::")
        while True:
            self.take("$")
            self.name()
            if self.value == "::" and self.ahead() == "<":
                self.i += 1
                self.skip_angles()
            if self.value == "::" and (self.tokens[self.i + 1][0] == "name" or self.ahead() == "$"):
                self.i += 1
                continue
            break
        if self.value == "!" and self.ahead() in ("(", "[", "{"):
            self.i += 1
            braces = self.value == "{"
            self.skip_tree()
            return Node("Macro", start, self.end, braces=braces)
        if self.value == "{" and not self.no_struct and self._is_struct_body():
            return self.struct_literal(start)
        return Node("Path", start, self.end)

    def _is_struct_body(self) -> bool:
        k, close = self.i + 1, self.match[self.i]
        if k == close:
            return True
        while self.tokens[k][0] == "doc" or self.tokens[k][1] == "#" and self.tokens[k + 1][1] == "[":
            k = k + 1 if self.tokens[k][0] == "doc" else self.match[k + 1] + 1
        first, after = self.tokens[k], self.tokens[k + 1][1]
        return first[1] == ".." or first[0] in ("name", "num") and after in (":", ",", "}") and (after != "}" or k + 1 == close)

    def struct_literal(self, start: int) -> Node:
        close = self.match[self.i]
        self.i += 1
        held, self.no_struct = self.no_struct, False
        kids = []
        while self.i < close:
            self.attributes()
            if self.take(".."):
                if self.i < close:
                    kids.append(self.expression())
            else:
                at = self.start
                self.next()
                kids.append(self.expression() if self.take(":") else Node("Path", at, self.end))
            if self.i < close and not self.take(","):
                self.fail("expected ,")
        self.no_struct = held
        self.i = close + 1
        return Node("StructLiteral", start, self.end, kids)

    def closure(self, start: int) -> Node:
        while self.value in ("move", "static", "async"):
            self.i += 1
        if not self.take("||"):
            self.expect("|")
            while self.value != "|":
                if self.kind == "eof" or self.value in (")", "]", "}"):
                    self.fail("expected |")
                if self.i in self.match:
                    self.skip_tree()
                elif self.value == "<":
                    self.skip_angles()
                else:
                    self.i += 1
            self.i += 1
        if self.take("->"):
            self.type_(False)
            return Node("Closure", start, 0, [self.block()])
        return Node("Closure", start, self.end, [self.expression()])

    def _if(self, start: int) -> Node:
        self.i += 1
        cond, then, other = self.condition(), self.block(), None
        if self.take("else"):
            other = self._if(self.start) if self.value == "if" else self.block()
        return Node("If", start, self.end, [cond, then, *([other] if other else [])], cond=cond)

    def _match(self, start: int) -> Node:
        self.i += 1
        subject = self.condition()
        self.expect("{")
        held, self.no_struct = self.no_struct, False
        arms = []
        while True:
            self.attributes()
            if self.take("}"):
                break
            self.take("|")
            self.pattern("=>", "if")
            guard = self.expression() if self.take("if") else None
            self.expect("=>")
            body = self.expression(statement=True)
            arms += [guard, body] if guard else [body]
            if not self.take(",") and self.value != "}" and body.kind not in BLOCK_LIKE:
                self.fail("expected ,")
            arms[-1].parts["arm"] = True
        self.no_struct = held
        return Node("Match", start, self.end, [subject, *arms], arms=sum(bool(a.parts.get("arm")) for a in arms), subject=subject)

    def _while(self, start: int) -> Node:
        self.i += 1
        cond = self.condition()
        return Node("While", start, 0, [cond, self.block()], cond=cond)

    def _for(self, start: int) -> Node:
        if self.ahead() == "<":
            self.i += 1
            self.skip_angles()
            return self.closure(start)
        self.i += 1
        self.pattern("in")
        self.i += 1
        cond = self.condition()
        return Node("For", start, 0, [cond, self.block()], cond=cond)

    def _loop(self, start: int) -> Node:
        self.i += 1
        return Node("Loop", start, 0, [self.block()])

    def _unsafe(self, start: int) -> Node:
        self.i += 1
        return Node("Unsafe", start, 0, [self.block()])

    def _const(self, start: int) -> Node:
        self.i += 1
        if self.value in ("|", "||", "move", "async"):
            return self.closure(start)
        return Node("ConstBlock", start, 0, [self.block()])

    def _async(self, start: int) -> Node:
        self.i += 1
        self.take("move")
        return Node("Async", start, 0, [self.block()])

    def _return(self, start: int) -> Node:
        self.i += 1
        return Node("Return", start, self.end, [self.expression()] if self._starts_expression() else [])

    def _break(self, start: int) -> Node:
        self.i += 1
        if self.kind == "life":
            self.i += 1
        return Node("Break", start, self.end, [self.expression()] if self._starts_expression() else [])

    def _continue(self, start: int) -> Node:
        self.i += 1
        if self.kind == "life":
            self.i += 1
        return Node("Continue", start, self.end)


_EXPRESSIONS = frozenset("if match while for loop unsafe const async return break continue".split())


def parse(text: str) -> list[Node]:
    """The items of a whole file; raises :class:`ParseFailure`."""
    try:
        return Parser(text).file()
    except RecursionError:
        raise ParseFailure("too deeply nested") from None
