"""A parser for TypeScript, JavaScript and JSX, in one pass over the text.

Tokens are read on demand, because what ``/``, ``<``, ``>`` and a backquote mean depends on where the
parser stands.  Trees are :class:`Node` values with children in source order; types are parsed for
what facts need (``any``, named references) and otherwise stay shallow.
"""

from __future__ import annotations

import re

from .common import Node, ParseFailure


_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/|<!--[^\n]*)*")
_NAME = re.compile(r"[^\W\d][\w$]*|[$][\w$]*|(?:\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})[\w$]*)+")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_PUNCT = re.compile(r"\?\?=|\*\*=|&&=|\|\|=|<<=|===|!==|\.\.\.|=>|\+\+|--|\*\*|<<|<=|==|!=|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_JSX_TEXT = re.compile(r"[^{<]*")
_JSX_NAME = re.compile(r"[^\W\d][\w$-]*|[$][\w$-]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\u2028": "", "\u2029": ""}

# The binding powers of ECMAScript's binary operators.
POWER = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor get set".split())


def unescape(body: str) -> str:
    """The value of a string literal's body."""
    if "\\" not in body:
        return body

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            number = int(code, 16)
            return chr(number) if number < 0x110000 else "\ufffd"
        return _SIMPLE.get(m[4], m[4])

    return _ESCAPE.sub(one, body)


class Parser:
    def __init__(self, text: str, typescript: bool, jsx: bool):
        self.text, self.ts, self.jsx = text, typescript, jsx
        self.end = 0  # where the last consumed token ended
        self.no_in = self.no_cond_arrow = False
        self.not_arrows: set[int] = set()
        if text.startswith("#!"):
            self.end = text.find("\n") if "\n" in text else len(text)
        self.advance(self.end)

    # --- tokens ---

    def advance(self, at: int) -> None:
        """Read the token that starts after white space from ``at``."""
        text = self.text
        self.start = at = _SPACE.match(text, at).end()
        self.newline = "\n" in text[self.end : at]
        if at >= len(text):
            self.type, self.value, self.stop = "eof", "", at
            return
        c = text[at]
        if m := _NAME.match(text, at):
            self.type = "name"
        elif c in "'\"":
            m, self.type = _STRING.match(text, at), "string"
        elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
            m, self.type = _NUMBER.match(text, at), "number"
        elif c == "`":
            self.type, self.value, self.stop = "`", "`", at + 1
            return
        else:
            m, self.type = _PUNCT.match(text, at), "punct"
        if not m:
            raise ParseFailure(f"unexpected character at {at}")
        self.value, self.stop = m[0], m.end()

    def next(self) -> str:
        value = self.value
        self.end = self.stop
        self.advance(self.stop)
        return value

    def save(self):
        return self.end, self.start, self.newline, self.type, self.value, self.stop

    def restore(self, state) -> None:
        self.end, self.start, self.newline, self.type, self.value, self.stop = state

    def at(self, *values: str) -> bool:
        return self.type in ("punct", "name") and self.value in values

    def take(self, *values: str) -> bool:
        if self.at(*values):
            self.next()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value}")

    def fail(self, what: str = "unexpected token"):
        raise ParseFailure(f"{what} at {self.start}, found {self.value[:20]!r}")

    def peek(self) -> tuple[str, str, bool]:
        """Type and value of the token after this one, and whether a line break comes before it."""
        state = self.save()
        self.next()
        out = self.type, self.value, self.newline
        self.restore(state)
        return out

    def semicolon(self) -> None:
        if not self.take(";") and not self.newline and not self.at("}") and self.type != "eof":
            self.fail("expected ;")

    def identifier(self) -> str:
        if self.type != "name" or self.value in RESERVED:
            self.fail("expected a name")
        return self.next()

    def attempt(self, rule):
        """Run ``rule``; on failure go back and return None."""
        state, flags = self.save(), (self.no_in, self.no_cond_arrow)
        try:
            return rule()
        except ParseFailure:
            self.restore(state)
            self.no_in, self.no_cond_arrow = flags
            return None

    # --- statements ---

    def program(self) -> Node:
        body = []
        while self.type != "eof":
            body.append(self.statement())
        return Node("Program", 0, len(self.text), body)

    def block(self) -> Node:
        start = self.start
        self.expect("{")
        body = []
        while not self.at("}"):
            body.append(self.statement())
        self.next()
        return Node("BlockStatement", start, self.end, body)

    def statement(self) -> Node:
        start, kind = self.start, self.type
        if kind == "punct":
            if self.value == "{":
                return self.block()
            if self.value == ";":
                self.next()
                return Node("EmptyStatement", start, self.end)
            if self.value == "@":
                decorators = self.decorators()
                node = self.statement()
                node.kids[:0] = decorators
                return node
        elif kind == "name":
            rule = getattr(self, f"_{self.value}_statement", None)
            if rule and self.value in _STATEMENTS:
                return rule(start)
            if node := self.declaration(start):
                return node
            if self.value not in RESERVED and self.peek()[1] == ":" and self.peek()[0] == "punct":
                self.next()
                self.next()
                return Node("LabeledStatement", start, self.end, [self.statement()])
        expr = self.expression()
        self.semicolon()
        return Node("ExpressionStatement", start, self.end, [expr])

    def declaration(self, start: int) -> Node | None:
        """Declarations that begin with a word that may also be a name."""
        word, (kind, after, newline) = self.value, self.peek()
        if word in ("var", "const", "let") and (word != "let" or kind == "name" and after not in ("in", "instanceof") or after in ("[", "{")):
            if word == "const" and after == "enum":
                self.next()
                return self._enum(start)
            node = self.variables()
            self.semicolon()
            node.end = self.end
            return node
        if word == "using" and kind == "name" and not newline and after not in RESERVED:
            node = self.variables()
            self.semicolon()
            return node
        if word == "async" and after == "function" and not newline:
            self.next()
            return self.function(start, declaration=True)
        if not self.ts:
            return None
        if word == "type" and kind == "name" and not newline and after not in ("in", "instanceof"):
            self.next()
            name = self.identifier()
            self.type_parameters()
            self.expect("=")
            body = self.type_()
            self.semicolon()
            return Node("TSTypeAlias", start, self.end, [body], name=name)
        if word == "interface" and kind == "name" and not newline:
            self.next()
            name = self.identifier()
            kids = self.type_parameters()
            while self.take("extends", ","):
                kids.append(self.type_())
            kids.append(self.object_type())
            return Node("TSInterface", start, self.end, kids, name=name)
        if word == "enum" and kind == "name":
            return self._enum(start)
        if word == "abstract" and after == "class":
            self.next()
            return self.class_(start, declaration=True)
        if word in ("namespace", "module", "global") and not newline and (kind == "string" or after == "{" and word == "global" or kind == "name" and after not in RESERVED | {"in", "of", "as"}):
            self.next()
            while not self.at("{", ";") and self.type != "eof" and not (self.newline and not self.at(".")):
                self.next()
            kids = [self.block()] if self.at("{") else []
            return Node("TSModule", start, self.end, kids)
        if word == "declare" and kind == "name" and not newline and after not in ("in", "instanceof", "as"):
            self.next()
            node = self.statement()
            return Node("TSDeclare", start, self.end, [node])
        return None

    def _enum(self, start: int) -> Node:
        self.next()
        name, kids = self.identifier(), []
        self.expect("{")
        while not self.at("}"):
            if self.at("["):
                self.next()
                kids.append(self.assignment())
                self.expect("]")
            else:
                self.next()
            if self.take("="):
                kids.append(self.assignment())
            if not self.take(","):
                break
        self.expect("}")
        return Node("TSEnum", start, self.end, kids, name=name)

    def variables(self) -> Node:
        start, kids = self.start, []
        kind = self.next()
        while True:
            at = self.start
            target = self.binding()
            self.take("!")
            types = [self.type_()] if self.take(":") else []
            init = self.assignment() if self.take("=") else None
            kids.append(Node("VariableDeclarator", at, self.end, [target, *types, *([init] if init else [])], id=target, init=init))
            if not self.take(","):
                break
        return Node("VariableDeclaration", start, self.end, kids, declares=kind)

    def _function_statement(self, start: int) -> Node:
        return self.function(start, declaration=True)

    def _class_statement(self, start: int) -> Node:
        return self.class_(start, declaration=True)

    def paren(self) -> Node:
        self.expect("(")
        expr = self.expression()
        self.expect(")")
        return expr

    def _if_statement(self, start: int) -> Node:
        self.next()
        kids = [self.paren(), self.statement()]
        if self.take("else"):
            kids.append(self.statement())
        return Node("IfStatement", start, self.end, kids)

    def _while_statement(self, start: int) -> Node:
        self.next()
        return Node("WhileStatement", start, self.end, [self.paren(), self.statement()])

    def _do_statement(self, start: int) -> Node:
        self.next()
        body = self.statement()
        self.expect("while")
        test = self.paren()
        self.take(";")
        return Node("DoWhileStatement", start, self.end, [body, test])

    def _for_statement(self, start: int) -> Node:
        self.next()
        self.take("await")
        self.expect("(")
        self.no_in, init = True, None
        if self.at("var", "const") or self.at("let") and (self.peek()[0] == "name" and self.peek()[1] not in ("in", "of") or self.peek()[1] in ("[", "{")):
            init = self.variables()
        elif not self.at(";"):
            init = self.expression()
        self.no_in = False
        kids = [init] if init else []
        for word, kind in (("of", "ForOfStatement"), ("in", "ForInStatement")):
            if init and self.at(word):
                self.next()
                kids.append(self.assignment() if word == "of" else self.expression())
                self.expect(")")
                return Node(kind, start, self.end, [*kids, self.statement()])
        for close in (";", ")"):
            self.expect(";")
            if not self.at(close):
                kids.append(self.expression())
        self.expect(")")
        return Node("ForStatement", start, self.end, [*kids, self.statement()])

    def _return_statement(self, start: int) -> Node:
        word = self.next()
        kids = [] if self.newline or self.at(";", "}") or self.type == "eof" else [self.expression()]
        self.semicolon()
        return Node("ReturnStatement" if word == "return" else "ThrowStatement", start, self.end, kids)

    _throw_statement = _return_statement

    def _break_statement(self, start: int) -> Node:
        word = self.next()
        if self.type == "name" and not self.newline and self.value not in RESERVED:
            self.next()
        self.semicolon()
        return Node("BreakStatement" if word == "break" else "ContinueStatement", start, self.end)

    _continue_statement = _break_statement

    def _debugger_statement(self, start: int) -> Node:
        self.next()
        self.semicolon()
        return Node("DebuggerStatement", start, self.end)

    def _with_statement(self, start: int) -> Node:
        self.next()
        return Node("WithStatement", start, self.end, [self.paren(), self.statement()])

    def _try_statement(self, start: int) -> Node:
        self.next()
        kids, handler = [self.block()], None
        at = self.start
        if self.take("catch"):
            parts = []
            if self.take("("):
                parts.append(self.binding())
                if self.take(":"):
                    parts.append(self.type_())
                self.expect(")")
            body = self.block()
            handler = Node("CatchClause", at, self.end, [*parts, body], body=body)
            kids.append(handler)
        if self.take("finally"):
            kids.append(self.block())
        elif handler is None:
            self.fail("expected catch")
        return Node("TryStatement", start, self.end, kids, handler=handler)

    def _switch_statement(self, start: int) -> Node:
        self.next()
        kids = [self.paren()]
        self.expect("{")
        while not self.at("}"):
            at, test = self.start, None
            if self.take("case"):
                test = self.expression()
            else:
                self.expect("default")
            self.expect(":")
            body = []
            while not self.at("case", "default", "}"):
                body.append(self.statement())
            kids.append(Node("SwitchCase", at, self.end, [*([test] if test else []), *body], test=test))
        self.next()
        return Node("SwitchStatement", start, self.end, kids)

    def string_node(self) -> Node:
        if self.type != "string":
            self.fail("expected a string")
        start, raw = self.start, self.next()
        return Node("StringLiteral", start, self.end, value=unescape(raw[1:-1]))

    def attributes(self) -> None:
        if self.take("with") or self.at("assert") and not self.newline and self.take("assert"):
            self.expression()

    def export_name(self) -> str:
        if self.type == "string":
            return unescape(self.next()[1:-1])
        if self.type != "name":
            self.fail("expected a name")
        return self.next()

    def name_list(self) -> list[tuple[str, str]]:
        """``{a, b as c, type d}``: (name there, name here)."""
        pairs = []
        self.expect("{")
        while not self.at("}"):
            if self.ts and self.at("type") and self.peek()[0] in ("name", "string") and self.peek()[1] != "as":
                self.next()
            elif self.ts and self.at("type") and self.peek()[1] == "as":
                state = self.save()
                self.next()
                self.next()
                if self.at("as") or self.type == "name" and self.peek()[1] not in (",", "}"):
                    self.restore(state)
                    self.next()
                else:
                    self.restore(state)
            name = self.export_name()
            pairs.append((name, self.export_name() if self.take("as") else name))
            if not self.take(","):
                break
        self.expect("}")
        return pairs

    def _import_statement(self, start: int) -> Node:
        if self.peek()[1] in ("(", "."):
            expr = self.expression()
            self.semicolon()
            return Node("ExpressionStatement", start, self.end, [expr])
        self.next()
        specifiers = []
        if self.type != "string":
            if self.at("type", "defer") and self.peek()[1] not in (",", "from", "=") or self.at("type") and self.peek()[1] == "from" and self._from_is_name():
                self.next()
            if self.type == "name":
                specifiers.append(self.identifier())
                if self.ts and self.take("="):
                    expr = self.expression()
                    self.semicolon()
                    return Node("TSImportEquals", start, self.end, [expr])
                self.take(",")
            if self.take("*"):
                self.expect("as")
                specifiers.append(f"* as {self.identifier()}")
            elif self.at("{"):
                specifiers += [there for there, _ in self.name_list()]
            self.expect("from")
        source = self.string_node()
        self.attributes()
        self.semicolon()
        return Node("ImportDeclaration", start, self.end, [source], source=source.value, specifiers=specifiers)

    def _from_is_name(self) -> bool:
        state = self.save()
        self.next()
        self.next()
        found = self.at("from")
        self.restore(state)
        return found

    def _export_statement(self, start: int) -> Node:
        self.next()
        if self.take("default"):
            at = self.start
            if self.at("function") or self.at("async") and self.peek()[1] == "function" and not self.peek()[2]:
                self.take("async")
                what = self.function(at, declaration=True)
            elif self.at("class", "@") or self.at("abstract") and self.peek()[1] == "class":
                decorators = self.decorators()
                self.take("abstract")
                what = self.class_(at, declaration=True)
                what.kids[:0] = decorators
            elif self.ts and self.at("interface") and self.peek()[0] == "name":
                what = self.declaration(at)
            else:
                what = self.assignment()
                self.semicolon()
            return Node("ExportDefault", start, self.end, [what], declaration=what)
        if self.take("*"):
            if self.take("as"):
                self.export_name()
            self.expect("from")
            source = self.string_node()
            self.attributes()
            self.semicolon()
            return Node("ExportAll", start, self.end, [source], source=source.value)
        if self.ts and self.take("="):
            expr = self.expression()
            self.semicolon()
            return Node("TSExportAssignment", start, self.end, [expr])
        if self.ts and self.at("as") and self.peek()[1] == "namespace":
            self.next()
            self.next()
            self.identifier()
            self.semicolon()
            return Node("TSNamespaceExport", start, self.end)
        if self.ts and self.at("type") and self.peek()[1] in ("{", "*"):
            self.next()
            if self.at("*"):
                self.next()
                if self.take("as"):
                    self.export_name()
                self.expect("from")
                source = self.string_node()
                self.semicolon()
                return Node("ExportAll", start, self.end, [source], source=source.value)
        if self.at("{"):
            pairs, source = self.name_list(), None
            if self.take("from"):
                source = self.string_node()
                self.attributes()
            self.semicolon()
            return Node("ExportNamed", start, self.end, [source] if source else [], specifiers=pairs, source=source.value if source else None)
        what = self.statement()
        return Node("ExportNamed", start, self.end, [what], declaration=what, specifiers=[])

    # --- functions and classes ---

    def decorators(self) -> list[Node]:
        out = []
        while self.take("@"):
            out.append(self.postfix(self.primary()))
        return out

    def binding(self) -> Node:
        """A binding target, without type or default."""
        start = self.start
        if self.take("["):
            kids = []
            while not self.at("]"):
                if self.take(","):
                    continue
                self.take("...")
                kids += self.binding_default()
                if not self.at("]"):
                    self.expect(",")
            self.next()
            return Node("ArrayPattern", start, self.end, kids)
        if self.take("{"):
            kids, properties = [], []
            while not self.at("}"):
                if self.take("..."):
                    kids.append(self.binding())
                else:
                    key, parts = self.property_key()
                    if self.take(":"):
                        parts += self.binding_default()
                        value = next((p for p in parts if p.kind == "BindingIdentifier"), None)
                        direct = parts[-1] is value
                        properties.append((False, value.name if direct and value else None))
                    else:
                        parts.append(Node("BindingIdentifier", start, self.end, name=key))
                        if self.take("="):
                            parts.append(self.assignment())
                        properties.append((True, key))
                    kids += parts
                if not self.take(","):
                    break
            self.expect("}")
            return Node("ObjectPattern", start, self.end, kids, properties=properties)
        name = self.next() if self.at("this") else self.identifier()
        return Node("BindingIdentifier", start, self.end, name=name)

    def binding_default(self) -> list[Node]:
        target = self.binding()
        return [target, self.assignment()] if self.take("=") else [target]

    def parameters(self) -> Node:
        start, items, kids = self.start, [], []
        self.expect("(")
        while not self.at(")"):
            kids += self.decorators()
            rest = self.take("...")
            while self.ts and self.at("public", "private", "protected", "readonly", "override") and (self.peek()[0] == "name" or self.peek()[1] in ("{", "[")):
                self.next()
            target = self.binding()
            self.take("?")
            types = [self.type_()] if self.take(":") else []
            default = [self.assignment()] if self.take("=") else []
            kids += [target, *types, *default]
            if not rest:
                items.append((target, types[0] if types else None))
            if not self.take(","):
                break
        self.expect(")")
        return Node("Parameters", start, self.end, kids, items=items)

    def return_type(self) -> list[Node]:
        if not self.at(":"):
            return []
        self.next()
        return [self.type_(predicate=True)]

    def function_rest(self) -> tuple[Node, list[Node], Node | None]:
        """Parameters, types and body after a function's name."""
        types = self.type_parameters()
        params = self.parameters()
        types += self.return_type()
        if self.at("{"):
            flags, self.no_in, self.no_cond_arrow = (self.no_in, self.no_cond_arrow), False, False
            body = self.block()
            self.no_in, self.no_cond_arrow = flags
            return params, types, body
        return params, types, None

    def function(self, start: int, declaration: bool) -> Node:
        self.expect("function")
        self.take("*")
        name = self.next() if self.type == "name" and not self.at("function") and self.value not in RESERVED else None
        params, types, body = self.function_rest()
        if body is None:
            if not self.ts:
                self.fail("expected a body")
            self.semicolon()
        kids = [params, *types, *([body] if body else [])]
        return Node("FunctionDeclaration" if declaration else "FunctionExpression", start, self.end, kids, name=name, params=params, body=body)

    def class_(self, start: int, declaration: bool) -> Node:
        self.expect("class")
        name = self.identifier() if self.type == "name" and not self.at("extends", "implements", "{") else None
        kids, heritage = self.type_parameters(), False
        if self.take("extends"):
            heritage = True
            kids.append(self.postfix(self.primary()))
            if self.at("<"):
                kids += self.type_arguments()
        if self.ts and self.take("implements"):
            kids.append(self.type_())
            while self.take(","):
                kids.append(self.type_())
        members = []
        self.expect("{")
        while not self.at("}"):
            if self.take(";"):
                continue
            members.append(self.member())
        self.next()
        return Node("ClassDeclaration" if declaration else "ClassExpression", start, self.end, [*kids, *members], name=name, members=members, heritage=heritage)

    def property_key(self) -> tuple[str | None, list[Node]]:
        """(static name if any, nodes)."""
        if self.take("["):
            flag, self.no_in = self.no_in, False
            expr = self.assignment()
            self.no_in = flag
            self.expect("]")
            return None, [expr]
        if self.take("#"):
            return "#" + self.next(), []
        if self.type == "string":
            node = self.string_node()
            return None, [node]
        if self.type in ("name", "number"):
            kind = self.type
            name = self.next()
            return (name if kind == "name" else None), []
        self.fail("expected a key")

    def member(self) -> Node:
        kids = self.decorators()
        start, words = self.start, set()
        while self.type == "name" and self.value in MODIFIERS:
            kind, after, newline = self.peek()
            if after in ("(", "=", ";", ":", "?", "!", "<", "}", ",") and kind == "punct" or newline and self.value not in ("static", "public", "private", "protected"):
                break
            words.add(self.next())
        if "static" in words and self.at("{"):
            return Node("StaticBlock", start, self.end, [*kids, self.block()])
        self.take("*")
        if self.ts and self.at("[") and self._index_signature():
            self.next()
            self.identifier()
            self.expect(":")
            kids.append(self.type_())
            self.expect("]")
            self.expect(":")
            kids.append(self.type_())
            self.semicolon()
            return Node("TSIndexSignature", start, self.end, kids)
        name, parts = self.property_key()
        kids += parts
        self.take("?", "!")
        if self.at("(", "<"):
            at = self.start
            params, types, body = self.function_rest()
            if body is None:
                self.semicolon()
            kind = "get" if "get" in words else "set" if "set" in words else "constructor" if name == "constructor" and "static" not in words else "method"
            value = Node("FunctionExpression", at, self.end, [params, *types, *([body] if body else [])], params=params, body=body)
            return Node("MethodDefinition", start, self.end, [*kids, value], name=name, method=kind, value=value)
        if self.take(":"):
            kids.append(self.type_())
        if self.take("="):
            kids.append(self.assignment())
        self.semicolon()
        return Node("PropertyDefinition", start, self.end, kids, name=name)

    def _index_signature(self) -> bool:
        state = self.save()
        self.next()
        found = self.type == "name" and self.peek()[1] == ":"
        self.restore(state)
        return found

    # --- expressions ---

    def expression(self) -> Node:
        start, first = self.start, self.assignment()
        if not self.at(","):
            return first
        kids = [first]
        while self.take(","):
            kids.append(self.assignment())
        return Node("SequenceExpression", start, self.end, kids)

    def assignment(self) -> Node:
        start = self.start
        if arrow := self.arrow():
            return arrow
        if self.at("yield") and self.peek()[1] not in ("=", ".", "=>", ":"):
            self.next()
            delegate = self.take("*")
            bare = not delegate and (self.newline or self.at(")", "]", "}", ",", ";", ":", "in", "of") or self.type == "eof")
            return Node("YieldExpression", start, self.end, [] if bare else [self.assignment()])
        left = self.conditional()
        op = self._assign_op()
        if op:
            return Node("AssignmentExpression", start, self.end, [left, self.assignment()], op=op)
        return left

    def _assign_op(self) -> str | None:
        if self.type != "punct":
            return None
        if self.value in ASSIGN:
            return self.next()
        if self.value == ">":
            for op in (">>>=", ">>="):
                if self.text.startswith(op, self.start):
                    self.stop = self.start + len(op)
                    self.next()
                    return op
        return None

    def arrow(self) -> Node | None:
        """An arrow function, if one starts here."""
        start = self.start
        if start in self.not_arrows or not (self.type == "name" and self.value not in RESERVED or self.at("(", "<")):
            return None
        if self.type == "name" and self.value != "async":
            if self.peek()[:2] != ("punct", "=>"):
                return None
        found = self.attempt(lambda: self._arrow_head(start))
        if found is None:
            self.not_arrows.add(start)
            return None
        params, types = found
        flags, self.no_cond_arrow = self.no_cond_arrow, False
        if self.at("{"):
            held, self.no_in = self.no_in, False
            body, simple = self.block(), False
            self.no_in = held
        else:
            body, simple = self.assignment(), True
        self.no_cond_arrow = flags
        return Node("ArrowFunctionExpression", start, self.end, [params, *types, body], params=params, body=body, expression=simple)

    def _arrow_head(self, start: int) -> tuple[Node, list[Node]]:
        if self.at("async"):
            kind, after, newline = self.peek()
            if not newline and (kind == "name" and after not in RESERVED or after in ("(", "<")):
                self.next()
        types = []
        if self.at("<"):
            if not self.ts:
                self.fail()
            types = self.type_parameters()
        if self.at("("):
            params = self.parameters()
            if self.at(":"):
                types += self.return_type()
                if self.no_cond_arrow and not self.at("=>"):
                    self.fail()
        else:
            target = self.binding()
            params = Node("Parameters", target.start, target.end, [target], items=[(target, None)])
        if self.newline or not self.take("=>"):
            self.fail("expected =>")
        return params, types

    def conditional(self) -> Node:
        start, test = self.start, self.binary(0)
        if not self.at("?"):
            return test
        self.next()
        flags = (self.no_in, self.no_cond_arrow)
        self.no_in = False
        # ``a ? (b) : c => d``: the colon belongs to the conditional unless an arrow needs it
        then = self.attempt(self._then)
        if then is None:
            self.no_cond_arrow = True
            state = self.save()
            self.not_arrows = {p for p in self.not_arrows if p < state[1]}
            then = self._without_arrow_types()
        self.no_in, self.no_cond_arrow = flags
        self.expect(":")
        return Node("ConditionalExpression", start, self.end, [test, then, self.assignment()])

    def _then(self) -> Node:
        node = self.assignment()
        if not self.at(":"):
            self.fail("expected :")
        return node

    def _without_arrow_types(self) -> Node:
        rule, self.return_type = self.return_type, lambda: self.fail()
        try:
            self.not_arrows = set()
            return self.assignment()
        finally:
            self.return_type = rule

    def operator(self) -> str | None:
        if self.type == "punct":
            if self.value == ">":
                for op in (">>>", ">>", ">="):
                    if self.text.startswith(op, self.start):
                        if self.text.startswith(op + "=", self.start) and op != ">=":
                            return None
                        return op
                return ">"
            return self.value if self.value in POWER else None
        if self.type == "name":
            if self.value == "in":
                return None if self.no_in else "in"
            if self.value == "instanceof" or self.ts and self.value in ("as", "satisfies") and not self.newline:
                return self.value
        return None

    def binary(self, least: int) -> Node:
        start, left = self.start, self.unary()
        while True:
            op = self.operator()
            if op is None or POWER[op] <= least:
                return left
            self.stop = self.start + len(op)
            self.next()
            if op in ("as", "satisfies"):
                kids = [left] if self.take("const") else [left, self.type_()]
                left = Node("TSAsExpression", start, self.end, kids)
                continue
            right = self.binary(POWER[op] - (op == "**"))
            left = Node("LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression", start, self.end, [left, right], op=op)

    def unary(self) -> Node:
        start = self.start
        if self.at("!", "~", "+", "-", "typeof", "void", "delete"):
            self.next()
            return Node("UnaryExpression", start, self.end, [self.unary()])
        if self.at("++", "--"):
            self.next()
            return Node("UpdateExpression", start, self.end, [self.unary()])
        if self.at("await") and not (self.peek()[0] == "punct" and self.peek()[1] in (")", "]", "}", ",", ";", ".", "=", "=>", ":", "?")):
            self.next()
            return Node("AwaitExpression", start, self.end, [self.unary()])
        if self.at("<") and self.ts and not self.jsx:
            self.next()
            kids = [] if self.take("const") else [self.type_()]
            self.expect(">")
            return Node("TSAsExpression", start, self.end, [*kids, self.unary()])
        expr = self.postfix(self.primary())
        if self.at("++", "--") and not self.newline:
            self.next()
            return Node("UpdateExpression", start, self.end, [expr])
        return expr

    def arguments(self) -> list[Node]:
        out = []
        self.expect("(")
        flags, self.no_in, self.no_cond_arrow = (self.no_in, self.no_cond_arrow), False, False
        while not self.at(")"):
            at = self.start
            if self.take("..."):
                out.append(Node("SpreadElement", at, self.end, [self.assignment()]))
            else:
                out.append(self.assignment())
            if not self.take(","):
                break
        self.no_in, self.no_cond_arrow = flags
        self.expect(")")
        return out

    def postfix(self, expr: Node, calls: bool = True) -> Node:
        start = expr.start
        while True:
            if self.take("."):
                private = self.take("#")
                if self.type != "name":
                    self.fail("expected a name")
                name = self.next()
                expr = Node("PrivateMember" if private else "StaticMember", start, self.end, [expr], object=expr, name=name)
            elif calls and self.at("?."):
                self.next()
                if self.at("("):
                    args = self.arguments()
                    expr = Node("CallExpression", start, self.end, [expr, *args], callee=expr, arguments=args)
                elif self.take("["):
                    expr = self._computed(start, expr)
                else:
                    private = self.take("#")
                    if self.type != "name":
                        self.fail("expected a name")
                    name = self.next()
                    expr = Node("PrivateMember" if private else "StaticMember", start, self.end, [expr], object=expr, name=name)
            elif self.take("["):
                expr = self._computed(start, expr)
            elif calls and self.at("("):
                args = self.arguments()
                expr = Node("CallExpression", start, self.end, [expr, *args], callee=expr, arguments=args)
            elif self.type == "`":
                quasi = self.template()
                expr = Node("TaggedTemplate", start, self.end, [expr, quasi])
            elif self.ts and self.at("!") and not self.newline:
                self.next()
                expr = Node("TSNonNull", start, self.end, [expr], expression=expr)
            elif self.ts and self.at("<"):
                types = self.attempt(self._call_types)
                if types is None:
                    return expr
                if calls and self.at("("):
                    args = self.arguments()
                    expr = Node("CallExpression", start, self.end, [expr, *types, *args], callee=expr, arguments=args)
                else:
                    expr = Node("TSInstantiation", start, self.end, [expr, *types])
            else:
                return expr

    def _computed(self, start: int, expr: Node) -> Node:
        flag, self.no_in = self.no_in, False
        inner = self.expression()
        self.no_in = flag
        self.expect("]")
        return Node("ComputedMember", start, self.end, [expr, inner])

    def _call_types(self) -> list[Node]:
        types = self.type_arguments()
        if not (self.at("(", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "^", "&", "|", "}") or self.type in ("`", "eof") or self.newline):
            self.fail()
        return types

    def primary(self) -> Node:
        start, kind, value = self.start, self.type, self.value
        if kind == "name":
            if value == "function":
                return self.function(start, declaration=False)
            if value == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                return self.function(start, declaration=False)
            if value == "class":
                return self.class_(start, declaration=False)
            if value == "new":
                return self.new(start)
            if value in ("true", "false", "null", "this", "super"):
                self.next()
                return Node({"null": "NullLiteral", "this": "This", "super": "Super"}.get(value, "BooleanLiteral"), start, self.end)
            if value == "import":
                self.next()
                if self.take("."):
                    self.next()
                return Node("Import", start, self.end)
            if value in RESERVED:
                self.fail()
            self.next()
            return Node("Identifier", start, self.end, name=value)
        if kind == "string":
            return self.string_node()
        if kind == "number":
            self.next()
            return Node("NumericLiteral", start, self.end)
        if kind == "`":
            return self.template()
        if value == "(":
            self.next()
            flags, self.no_in, self.no_cond_arrow = (self.no_in, self.no_cond_arrow), False, False
            expr = self.expression()
            self.no_in, self.no_cond_arrow = flags
            self.expect(")")
            return Node("Parenthesized", start, self.end, [expr], expression=expr)
        if value == "[":
            return self.array(start)
        if value == "{":
            return self.object(start)
        if value in ("/", "/="):
            m = _REGEX.match(self.text, start)
            if not m:
                self.fail("expected a regular expression")
            self.end = m.end()
            self.advance(m.end())
            return Node("RegExpLiteral", start, self.end)
        if value == "<" and self.jsx:
            return self.jsx_element()
        if value == "#":
            self.next()
            self.next()
            return Node("PrivateName", start, self.end)
        if value == "@":
            decorators = self.decorators()
            node = self.class_(self.start, declaration=False)
            node.kids[:0] = decorators
            return node
        self.fail()

    def new(self, start: int) -> Node:
        self.next()
        if self.take("."):
            self.next()
            return Node("MetaProperty", start, self.end)
        at = self.start
        callee = self.new(at) if self.at("new") else self.postfix(self.primary(), calls=False)
        args = self.arguments() if self.at("(") else []
        return Node("NewExpression", start, self.end, [callee, *args])

    def array(self, start: int) -> Node:
        self.next()
        kids = []
        flags, self.no_in, self.no_cond_arrow = (self.no_in, self.no_cond_arrow), False, False
        while not self.at("]"):
            if self.take(","):
                continue
            at = self.start
            if self.take("..."):
                kids.append(Node("SpreadElement", at, self.end, [self.assignment()]))
            else:
                kids.append(self.assignment())
            if not self.at("]"):
                self.expect(",")
        self.no_in, self.no_cond_arrow = flags
        self.next()
        return Node("ArrayExpression", start, self.end, kids)

    def object(self, start: int) -> Node:
        self.next()
        kids = []
        flags, self.no_in, self.no_cond_arrow = (self.no_in, self.no_cond_arrow), False, False
        while not self.at("}"):
            at = self.start
            if self.take("..."):
                kids.append(Node("SpreadElement", at, self.end, [self.assignment()]))
            else:
                while self.at("async", "get", "set") and (self.peek()[0] in ("name", "string", "number") or self.peek()[1] in ("[", "*", "#")):
                    self.next()
                self.take("*")
                name, parts = self.property_key()
                if self.at("(", "<"):
                    params, types, body = self.function_rest()
                    value = Node("FunctionExpression", at, self.end, [params, *types, *([body] if body else [])], params=params, body=body)
                    kids.append(Node("Property", at, self.end, [*parts, value]))
                elif self.take(":"):
                    kids.append(Node("Property", at, self.end, [*parts, self.assignment()]))
                else:
                    if name is None:
                        self.fail()
                    parts.append(Node("Identifier", at, self.end, name=name))
                    if self.take("="):
                        parts.append(self.assignment())
                    kids.append(Node("Property", at, self.end, parts))
            if not self.take(","):
                break
        self.no_in, self.no_cond_arrow = flags
        self.expect("}")
        return Node("ObjectExpression", start, self.end, kids)

    def template(self, types: bool = False) -> Node:
        """A template literal; the current token is its opening backquote."""
        start, at, quasis, kids = self.start, self.start + 1, [], []
        text = self.text
        piece = at
        while True:
            if at >= len(text):
                raise ParseFailure("unterminated template")
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                quasis.append(text[piece:at])
                self.end = at + 1
                self.advance(at + 1)
                return Node("TemplateLiteral", start, self.end, kids, quasis=quasis)
            elif c == "$" and text[at + 1 : at + 2] == "{":
                quasis.append(text[piece:at])
                self.end = at + 2
                self.advance(at + 2)
                flags, self.no_in, self.no_cond_arrow = (self.no_in, self.no_cond_arrow), False, False
                kids.append(self.type_() if types else self.expression())
                self.no_in, self.no_cond_arrow = flags
                if not self.at("}"):
                    self.fail("expected }")
                at = piece = self.stop
            else:
                at += 1

    # --- JSX ---

    def jsx_name(self) -> str:
        """Read an element or attribute name at the current token, hyphens and dots included."""
        m = _JSX_NAME.match(self.text, self.start)
        if not m:
            self.fail("expected a name")
        self.end = m.end()
        self.advance(m.end())
        name = m[0]
        while self.at(".", ":"):
            sep = self.next()
            name += sep + self.jsx_name()
        return name

    def jsx_element(self) -> Node:
        start = self.start
        self.expect("<")
        if self.at(">"):
            return Node("JSXFragment", start, self.end, self.jsx_children(self.stop, ""))
        name, kids = self.jsx_name(), []
        if self.ts and self.at("<"):
            kids += self.type_arguments()
        while not self.at(">", "/"):
            if self.take("{"):
                self.expect("...")
                kids.append(self.assignment())
                self.expect("}")
                continue
            self.jsx_name()
            if self.at("="):
                at = _SPACE.match(self.text, self.stop).end()
                if self.text[at : at + 1] in ("'", '"'):
                    close = self.text.find(self.text[at], at + 1)
                    if close < 0:
                        self.fail("unterminated attribute")
                    kids.append(Node("StringLiteral", at, close + 1, value=self.text[at + 1 : close]))
                    self.end = close + 1
                    self.advance(close + 1)
                else:
                    self.next()
                    if self.take("{"):
                        kids.append(self.assignment())
                        self.expect("}")
                    else:
                        kids.append(self.jsx_element())
        if self.take("/"):
            if not self.at(">"):
                self.fail("expected >")
            self.next()
            return Node("JSXElement", start, self.end, kids)
        return Node("JSXElement", start, self.end, kids + self.jsx_children(self.stop, name))

    def jsx_children(self, at: int, name: str) -> list[Node]:
        """Children after an opening tag that ends at ``at``, up to the closing tag of ``name``."""
        kids, text = [], self.text
        while True:
            at = _JSX_TEXT.match(text, at).end()
            if at >= len(text):
                raise ParseFailure(f"unclosed element {name}")
            self.end = at
            if text[at] == "{":
                self.advance(at)
                self.next()
                if self.take("..."):
                    kids.append(self.assignment())
                elif not self.at("}"):
                    kids.append(self.expression())
                if not self.at("}"):
                    self.fail("expected }")
                at = self.stop
                continue
            self.advance(at)
            if self.peek()[1] == "/" or text.startswith("</", at):
                self.next()
                self.next()
                closing = "" if self.at(">") else self.jsx_name()
                if closing != name or not self.at(">"):
                    self.fail(f"expected </{name}>")
                self.next()
                return kids
            kids.append(self.jsx_element())
            at = self.end

    # --- types ---

    def type_parameters(self) -> list[Node]:
        if not (self.ts and self.at("<")):
            return []
        self.next()
        kids = []
        while not self.at(">"):
            while self.at("const", "in", "out") and self.peek()[0] == "name":
                self.next()
            self.identifier()
            if self.take("extends"):
                kids.append(self.type_())
            if self.take("="):
                kids.append(self.type_())
            if not self.take(","):
                break
        self.close_angle()
        return kids

    def close_angle(self) -> None:
        if self.type != "punct" or self.value[0] != ">":
            self.fail("expected >")
        self.stop = self.start + 1
        self.next()

    def type_arguments(self) -> list[Node]:
        self.expect("<")
        kids = []
        while not self.at(">"):
            kids.append(self.type_())
            if not self.take(","):
                break
        self.close_angle()
        return kids

    def type_(self, predicate: bool = False) -> Node:
        start = self.start
        if predicate and self.at("asserts") and self.peek()[0] == "name" and not self.peek()[2]:
            self.next()
        if predicate and self.type == "name" and self.peek()[1] == "is" and not self.peek()[2]:
            self.next()
            self.next()
        found = self.union()
        if self.at("extends") and not self.newline and not getattr(self, "_no_extends", False):
            self.next()
            held, self._no_extends = getattr(self, "_no_extends", False), True
            kids = [found, self.union()]
            self._no_extends = held
            self.expect("?")
            kids.append(self.type_())
            self.expect(":")
            kids.append(self.type_())
            return Node("TSConditional", start, self.end, kids)
        return found

    def union(self) -> Node:
        start = self.start
        self.take("|", "&")
        kids = [self.type_operator()]
        while self.at("|", "&"):
            self.next()
            kids.append(self.type_operator())
        return kids[0] if len(kids) == 1 else Node("TSUnion", start, self.end, kids)

    def type_operator(self) -> Node:
        if self.at("keyof", "unique", "readonly", "infer") and (self.peek()[0] in ("name", "string", "`") or self.peek()[1] in ("(", "[", "{")):
            word = self.next()
            node = self.type_operator()
            if word == "infer" and self.at("extends"):
                self.attempt(self._infer_constraint)
            return node
        node = self.type_primary()
        while self.at("[") and not self.newline:
            self.next()
            kids = [node]
            if not self.at("]"):
                kids.append(self.type_())
            self.expect("]")
            node = Node("TSIndexed", node.start, self.end, kids)
        return node

    def _infer_constraint(self) -> None:
        self.next()
        held, self._no_extends = getattr(self, "_no_extends", False), True
        try:
            self.union()
        finally:
            self._no_extends = held
        if self.at("?"):
            self.fail()

    def function_type(self, start: int) -> Node:
        kids = self.type_parameters()
        params = self.parameters()
        self.expect("=>")
        return Node("TSFunctionType", start, self.end, [*kids, params, self.type_(predicate=True)])

    def type_primary(self) -> Node:
        start = self.start
        if self.at("new") or self.at("abstract") and self.peek()[1] == "new":
            self.take("abstract")
            self.next()
            return self.function_type(start)
        if self.at("<"):
            return self.function_type(start)
        if self.at("("):
            held, self._no_extends = getattr(self, "_no_extends", False), False
            try:
                found = self.attempt(lambda: self.function_type(start))
                if found is not None:
                    return found
                self.next()
                inner = self.type_()
                self.expect(")")
                return inner
            finally:
                self._no_extends = held
        if self.at("{"):
            held, self._no_extends = getattr(self, "_no_extends", False), False
            try:
                return self.object_type()
            finally:
                self._no_extends = held
        if self.take("["):
            kids = []
            while not self.at("]"):
                self.take("...")
                if self.type == "name" and (self.peek()[1] == ":" or self.peek()[1] == "?"):
                    state = self.save()
                    self.next()
                    self.take("?")
                    if not self.take(":"):
                        self.restore(state)
                kids.append(self.type_())
                self.take("?")
                if not self.take(","):
                    break
            self.expect("]")
            return Node("TSTuple", start, self.end, kids)
        if self.type == "`":
            return self.template(types=True)
        if self.type == "string":
            return self.string_node()
        if self.type == "number":
            self.next()
            return Node("NumericLiteral", start, self.end)
        if self.take("-"):
            self.next()
            return Node("NumericLiteral", start, self.end)
        if self.type != "name":
            self.fail("expected a type")
        if self.at("typeof"):
            self.next()
            if self.at("import"):
                return self.type_primary()
            while True:
                self.take("#")
                self.next()
                if not self.take("."):
                    break
            kids = self.type_arguments() if self.at("<") and not self.newline else []
            return Node("TSTypeQuery", start, self.end, kids)
        if self.at("import"):
            self.next()
            kids = self.arguments()
            while self.take("."):
                self.next()
            if self.at("<"):
                kids += self.type_arguments()
            return Node("TSImportType", start, self.end, kids)
        name = self.next()
        if name in ("null", "true", "false"):
            return Node("NullLiteral" if name == "null" else "BooleanLiteral", start, self.end)
        if name == "any":
            return Node("TSAny", start, self.end)
        dotted = False
        while self.at(".") and self.peek()[0] == "name":
            dotted = True
            self.next()
            self.next()
        kids = self.type_arguments() if self.at("<") and not self.newline else []
        keyword = name in ("string", "number", "boolean", "void", "never", "unknown", "object", "undefined", "symbol", "bigint", "this", "intrinsic") and not kids and not dotted
        return Node("TSKeyword" if keyword else "TSTypeReference", start, self.end, kids, name=None if dotted else name)

    def object_type(self) -> Node:
        """Members of an interface or object type, mapped types included."""
        start, kids = self.start, []
        self.expect("{")
        while not self.at("}"):
            if self.take("+", "-"):
                continue
            while self.at("readonly", "get", "set", "static") and (self.peek()[0] in ("name", "string", "number") or self.peek()[1] in ("[", "#")):
                self.next()
            if self.take("["):
                if self.type == "name" and self.peek()[1] in (":", "in"):
                    self.next()
                    self.next()
                    kids.append(self.type_())
                    if self.take("as"):
                        kids.append(self.type_())
                else:
                    kids.append(self.assignment())
                self.expect("]")
            elif self.at("new") and self.peek()[1] in ("(", "<"):
                self.next()
            elif not self.at("(", "<"):
                kids += self.property_key()[1]
            self.take("+", "-")
            self.take("?")
            if self.at("(", "<"):
                kids += self.type_parameters()
                kids.append(self.parameters())
                kids += self.return_type()
            elif self.take(":"):
                kids.append(self.type_())
            if not self.take(";", ",") and not self.newline and not self.at("}"):
                self.fail("expected ;")
        self.next()
        return Node("TSObjectType", start, self.end, kids)


_STATEMENTS = frozenset("function class if while do for return throw break continue debugger with try switch import export".split())


def parse(text: str, extension: str) -> Node:
    """The tree of a whole file; raises :class:`ParseFailure`."""
    typescript = extension in (".ts", ".tsx")
    try:
        return Parser(text, typescript, jsx=extension != ".ts").program()
    except RecursionError:
        raise ParseFailure("too deeply nested") from None
