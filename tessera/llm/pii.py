"""Personal data by rules and candidate gradient boosting, with DataFrame functions only (operator 10).

*Base rules* find e-mail addresses, IPv4 addresses, payment cards and international phone numbers
by pattern and check; what they find is always kept.  *Candidate generators* with high recall then
propose further, overlapping spans: written-out addresses, IPv6, card-like digit groups, phone
numbers without a plus, and unbroken runs of letters and digits that may be credentials (the kind
``secret``, which has no base rule).  Gradient-boosted trees over format and context features give
each candidate a score; a threshold per kind, calibrated for precision on strings whose words, cues
and formats the trees have not seen, selects what is added.  Of overlapping candidates above their
thresholds the surest stays.

Matching needs positions, which SQL's regular expressions do not return: a text split by a pattern
gives the pieces between the matches, so running sums of piece and match lengths are the offsets
(code points).  Everything is linear in a text, or linear times a logarithm: running sums go by
blocks (an accumulator that is appended to is copied), a candidate's context comes from the pieces
beside it, base spans are met by binary search, and a text is cut at offsets block by block.
Patterns start only where a match can start and use possessive loops.

Trees are fitted once per process, on the driver, on ``TRAINING_ROWS`` generated labelled strings
(the bound is that parameter); their features come from the same SQL expressions that score
documents.  Scale: one map over the documents, no shuffle, no Python worker.

Defined results: null and empty texts have no spans; overlaps between kinds are kept by the base
rules; an added span never overlaps a base span or a surer added one (ties: the kind listed first,
then the earlier start); repeated rows give one row each; an empty table gives an empty result;
extra columns are ignored by the query and carried by the stage.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: the base kinds, and credentials.
ALL_KINDS = (*KINDS, "secret")
#: Generated labelled strings that the trees see, and as many again that calibrate; trees, depth, shrinkage; precision asked of added spans.
TRAINING_ROWS, TREES, DEPTH, SHRINKAGE, PRECISION = 3000, 24, 3, 0.3, 0.98

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match; a cheap test before the pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Every candidate has 6 to 200 characters, and those of one kind never overlap.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({<]?(?:@|at|AT)[\])}>]? ?[A-Za-z0-9-]{1,63}+ ?[\[({<]?(?:\.|dot|DOT)[\])}>]? ?[A-Za-z]{2,12}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\(?[0-9]{2,5}\)?[ .-]{1,2}){1,4}[0-9]{3,5}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,199}+[0-9])(?=[0-9+/_=-]{0,199}+[A-Za-z])[A-Za-z0-9+/_=-]{16,200}+(?![A-Za-z0-9+/_=-])",
}
GENERATOR_NEEDS = {"email": r"(?:@|\bat\b|[\[({<]at|AT).{1,80}(?:dot|DOT|\.)", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]{2}", "phone": r"[0-9]\)?[ .-]{1,2}[0-9]", "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16}"}
#: Candidates that can start within the length of the longest one, all kinds together.
NEIGHBOURS = 130
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|address|correo|courriel|@)",
    "ip": r"(?i)(?:\bip|host|server|addr|login|from|client|gateway|dns)",
    "card": r"(?i)(?:card|visa|master|credit|debit|payment|amex|cc|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|number|whatsapp|dial|contact|sms)",
    "secret": r"(?i)(?:token|key|secret|passw|pwd|auth|bearer|credential|jwt|signature)",
}
AGAINST = r"(?i)(?:isbn|order|invoice|version|ver|date|page|id|ref|sku|serial|build|chapter|section|figure|total|price|sum|commit|branch|file|path|image|url|[$€£#=/]|v)\s*[:#.=]?\s*$"
WINDOW = 24
#: Elements of a running sum that share one accumulator, and characters of a text that are cut from at once.
BLOCK, CUT = 256, 1024


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and deeply ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# SQL text rather than columns where an expression is long and used often: it reaches the JVM in one call.


def _scan(values: str, op: str) -> str:
    """Running totals; ``op`` is SQL over a and b."""
    step = f"transform(array({op.format(a='s.at', b='x')}), y -> named_struct('at', y, 'out', concat(s.out, array(y))))[0]"
    return f"aggregate({values}, named_struct('at', 0, 'out', cast(array() AS array<int>)), (s, x) -> {step}, s -> s.out)"


def running(values: str, op: str = "({a} + {b})") -> str:
    """SQL of the running totals (each with its own element) of an array of ints from 0, under an associative ``op``.

    Appending copies the accumulator, so values go by blocks: totals within each, and of the blocks before.
    """
    blocks = f"transform(sequence(0, cast(floor((size(v) - 1) / {BLOCK}) AS int)), k -> slice(v, k * {BLOCK} + 1, {BLOCK}))"
    ends = _scan(f"transform(bs, b -> aggregate(b, 0, (p, q) -> {op.format(a='p', b='q')}))", op)
    shifted = f"transform({_scan('b', op)}, t -> {op.format(a='coalesce(get(e, j - 1), 0)', b='t')})"
    whole = f"transform(array({blocks}), bs -> transform(array({ends}), e -> flatten(transform(bs, (b, j) -> {shifted})))[0])[0]"
    return f"transform(array({values}), v -> CASE WHEN size(v) <= {BLOCK} THEN {_scan('v', op)} ELSE {whole} END)[0]"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; ``digits`` is read digit by digit, so a computed one comes through :func:`let`."""

    def weigh(i):
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return F.when((F.length(digits) - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + weigh(i)) % 10 == 0).otherwise(False)


def _valid(kind: str, match: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.regexp_replace(p, r"^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(_digits(match), lambda digits: F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def matches(text: str, pattern: str, kind: int | None = None) -> str:
    """SQL of array<struct<start, end, value>>: the leftmost non-overlapping matches of a pattern in an SQL string, in order.

    Candidates, of a ``kind``, have that number first and at their end ``before``, the last ``WINDOW``
    characters ahead of a match as far as the match before reaches back, and ``after``, the next one.
    """
    first, rest = "", ""
    if kind is not None:
        before = f"right(CASE WHEN length(get(m.gaps, k)) >= {WINDOW} THEN get(m.gaps, k) ELSE concat(coalesce(get(m.found, k - 1), ''), get(m.gaps, k)) END, {WINDOW})"
        after = "left(CASE WHEN get(m.gaps, k + 1) <> '' THEN get(m.gaps, k + 1) ELSE coalesce(get(m.found, k + 1), '') END, 1)"
        first, rest = f"'kind', {kind}, ", f", 'before', {before}, 'after', {after}"
    ends = running("transform(m.found, (w, k) -> length(get(m.gaps, k)) + length(w))")
    made = f"transform(m.found, (w, k) -> named_struct({first}'start', e[k] - length(w), 'end', e[k], 'value', w{rest}))"
    split = f"named_struct('gaps', split({text}, r'{pattern}', -1), 'found', regexp_extract_all({text}, r'{pattern}', 0))"
    return f"transform(array({split}), m -> transform(array({ends}), e -> {made})[0])[0]"


_EMPTY = "array<struct<start:int,end:int,value:string>>"


def _held(text: str) -> str:
    return f"coalesce(`{text}`, '')"


def base_spans(text: str, kind: str) -> Column:
    """The valid base spans of one kind in a column of texts."""
    held = F.expr(_held(text))
    found = F.filter(F.expr(matches(_held(text), BASE[kind])), lambda span: _valid(kind, span["value"]))
    may = F.contains(held, F.lit(NEEDS[kind])) if NEEDS[kind] else held.rlike("[0-9](?:[ -]?[0-9]){15}")
    return F.when(may, found).otherwise(F.array().cast(_EMPTY))


def with_base(docs: DataFrame, text: str = "text", prefix: str = "__pii_") -> DataFrame:
    """``docs`` with one array of valid base spans per kind."""
    return docs.withColumns({f"{prefix}{kind}": base_spans(text, kind) for kind in KINDS})


FEATURES = ("kind", "length", "digits", "groups", "longest", "dots", "dashes", "spaces", "parens", "letters", "at_sign", "luhn", "context", "against", "glued_before", "glued_after", "first_digit", "zeros", "distinct", "hex", "cases")


def features(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """array<double> in the order of FEATURES: a candidate's format and the words around it; ``kind`` is a place in ALL_KINDS."""
    count = lambda what: F.regexp_count(value, F.lit(what)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    cue = F.coalesce(*[F.when(kind == i, before.rlike(CONTEXT[k])) for i, k in enumerate(ALL_KINDS)], F.lit(False))
    return let(_digits(value), lambda digits: F.array(
        kind.cast("double"),
        F.length(value).cast("double"),
        F.length(digits).cast("double"),
        count("[0-9]+"),
        F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda g: F.length(g))).cast("double"),
        count(r"\."),
        count("-"),
        count(" "),
        count(r"[()\[\]{}]"),
        count("[A-Za-z]"),
        flag(F.contains(value, F.lit("@"))),
        flag(F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)),
        flag(cue),
        flag(before.rlike(AGAINST)),
        flag(before.rlike(r"[A-Za-z0-9_./-]$")),
        flag(after.rlike(r"^[A-Za-z0-9_/-]")),
        F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0)),
        F.regexp_count(digits, F.lit("0")).cast("double"),
        F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        flag(value.rlike("^[0-9A-Fa-f]+$")),
        flag(value.rlike("[a-z]")) + flag(value.rlike("[A-Z]")),
    ))


#: Words before a value that speak for its kind, by kind: the first half trains, the second calibrates; and words that speak against it.
CUES = {
    "email": ("email", "contact", "write to", "mail address"), "ip": ("from ip", "server", "host", "client"), "card": ("card", "visa", "credit card", "payment by"),
    "phone": ("phone", "call", "tel.", "mobile"), "secret": ("token =", "api key:", "secret", "password =", "bearer", "auth:"),
}
DECOYS = ("order", "version", "isbn", "page", "ref", "invoice", "total $", "serial")
DECOY_NAMES = ("commit", "file", "path", "build", "image", "branch")


def training_rows(n: int = TRAINING_ROWS, seed: int = 11, held_out: bool = False) -> list[tuple[str, str, str, str, int]]:
    """Generated (kind, before, value, after, label): formats in which people write personal data, and look-alikes.

    Held-out rows are made of other letters, cues and formats than those that train.
    """
    rng = random.Random(seed + held_out)
    letters = "aeioubcdfgjkpqxyz" if held_out else "abcdefghilmnoprstuvw"
    mine = lambda options: rng.choice(options[1::2] if held_out and len(options) > 1 else options[::2] if len(options) > 1 else options)
    draw = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    d = lambda k: draw(k, "0123456789")
    word = lambda: draw(rng.randint(2, 9), letters)
    low, mixed = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def grouped(digits: str, sep: str) -> str:
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def check_digit(body: str) -> str:
        total = sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def positive(kind: str) -> tuple[str, str]:
        if kind == "secret":
            value = mine((draw(40, low), draw(32, low), draw(rng.randint(24, 48), mixed), draw(64, low), "sk_" + draw(32, mixed), "ghp_" + draw(36, mixed)))
            return f"{word()} {mine(CUES[kind])} {rng.choice(('', chr(34), chr(39)))}", value.upper() if rng.random() < 0.2 else value
        before = f"{word()} {mine(CUES[kind])} " if rng.random() < 0.7 else f"{word()} {word()} "
        if kind == "email":
            a, z = mine((("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "), ("@", "."), (" @ ", ".")))
            return before, f"{word()}{rng.choice(('', '.' + word(), d(2)))}{a}{word()}{z}{mine(('com', 'org', 'net', 'de', 'fr', 'io'))}"
        if kind == "ip":
            return before, ":".join(draw(4, low) for _ in range(8))
        if kind == "card":
            digits = check_digit(rng.choice("3456") + d(rng.choice((12, 13, 14, 14, 14))))
            return before, mine((digits, grouped(digits, " "), grouped(digits, "-"), digits))
        s = rng.choice(" .-")
        return before, mine((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"({d(3)}){s}{d(3)}{s}{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(3)}", f"0{d(2)}-{d(2)} {d(2)} {d(3)}"))

    def negative(kind: str) -> tuple[str, str]:
        before = f"{word()} {mine(DECOYS)} " if rng.random() < 0.5 else f"{word()} {word()} "
        if kind == "email":
            return f"{word()} ", mine((f"{word()} at {word()}.{word()[:5]}", f"{word()} at {word()}. {word()[:6]}", f"{word()}@ {word()}. {word()[:5]}", f"{word()} at {word()}. {word()[:4]}"))
        if kind == "ip":
            return before, mine((f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", ":".join(d(2) for _ in range(5)), f"{d(1)}:{d(2)}:{d(2)}:{d(2)}", ":".join(d(1) for _ in range(6))))
        if kind == "secret":
            slug = "-".join([word() for _ in range(rng.randint(2, 5))] + [d(rng.randint(1, 4)).rjust(1, "1")])
            value = mine((slug.ljust(16, "x"), f"{word()}/{word()}/{word()}_{d(4)}".ljust(16, "a"), draw(40, low), f"{d(4)}-{d(2)}-{d(2)}T{d(2)}-{d(2)}-{d(2)}", f"IMG_{d(8)}_{d(6)}", f"{draw(8, low)}-{draw(4, low)}-{draw(4, low)}-{draw(4, low)}-{draw(12, low)}"))
            plain = rng.random() < 0.3 and not all(c in low for c in value)
            return (f"{word()} {word()} " if plain else f"{word()} {mine(DECOY_NAMES)} "), value
        if kind == "card":
            digits = d(rng.choice((13, 14, 15, 16, 16, 16, 17, 18, 19)))
            passes = check_digit(digits[:-1]) == digits
            value = rng.choice((digits, digits, grouped(digits, " ")))
            return (rng.choice((before, f"{word()} {mine(CUES[kind])} ")) if not passes else f"{word()} isbn "), value
        return before, mine((f"{d(4)}-{d(2)} {d(3)}", f"{d(2)} {d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)}", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", f"{d(5)}-{d(5)}", f"{d(2)}-{d(2)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}"))

    rows = []
    for k in range(n):
        kind, label = ALL_KINDS[k % len(ALL_KINDS)], int(k // len(ALL_KINDS) % 2 == 0)
        before, value = (positive if label else negative)(kind)
        rows.append((kind, before[-WINDOW:], value, rng.choice((" ", ".", ", ", '" ', " " + word())), label))
    return rows


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list]:
    """Logistic gradient boosting with exact splits: (bias, trees); a tree is (feature, cut, left, right) or a number."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    score, forest = np.full(len(y), bias), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        best, G, H = None, g[rows].sum(), h[rows].sum()
        if level and len(rows) > 20:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                values = x[order, f]
                borders = np.flatnonzero(values[1:] > values[:-1])
                if len(borders):
                    gl, hl = np.cumsum(g[order])[borders], np.cumsum(h[order])[borders]
                    gains = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    k = int(gains.argmax())
                    if best is None or gains[k] > best[0] + 1e-9:
                        best = (float(gains[k]), f, float(values[borders[k]] + values[borders[k] + 1]) / 2)
        if best is None or best[0] < 1e-3:
            return float(SHRINKAGE * G / (H + 1))
        left = x[rows, best[1]] < best[2]
        return best[1], best[2], grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1)

    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - q, q * (1 - q), depth)
        forest.append(tree)
        score = score + np.array([leaf(tree, row) for row in x])
    return bias, forest


def leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


class Forest:
    """A fitted forest and the raw score from which a candidate of each kind is selected.

    Trees are padded to full depth and laid out in three constant arrays, over which one small
    expression walks: the plan does not grow with the forest.
    """

    def __init__(self, bias: float, trees: list, thresholds: dict[str, float]):
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    def expression(self, f: Column) -> Column:
        inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
        feature, cut, value = [], [], []

        def lay(tree, level: int) -> list:
            """Nodes by level, left to right."""
            rows = [[tree]]
            for _ in range(level):
                rows.append([side for t in rows[-1] for side in (t[2:] if isinstance(t, tuple) else (t, t))])
            return rows

        for tree in self.trees:
            rows = lay(tree, DEPTH)
            for t in (t for row in rows[:-1] for t in row):
                feature.append(t[0] if isinstance(t, tuple) else 0)
                cut.append(float(t[1]) if isinstance(t, tuple) else 0.0)
            value += [float(t) for t in rows[-1]]
        features_, cuts, values = F.lit(feature), F.lit(cut), F.lit(value)

        def add(total, k):
            node = F.lit(0)
            for _ in range(DEPTH):
                at = k * inner + node
                node = 2 * node + F.when(F.get(f, F.get(features_, at)) < F.get(cuts, at), 1).otherwise(2)
            return total + F.get(values, k * leaves + node - inner)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(self.trees) - 1)), F.lit(float(self.bias)), add)


_FITTED: dict[int, Forest] = {}


def _featured(spark: SparkSession, rows: list[tuple]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(kinds, features, labels) of generated rows; their number is a parameter."""
    made = spark.createDataFrame([(k, ALL_KINDS.index(r[0]), *r) for k, r in enumerate(rows)], "k long, number int, kind string, before string, value string, after string, label int")
    made = made.select("k", "kind", "label", features(F.col("number"), F.col("value"), F.col("before"), F.substring("after", 1, 1)).alias("f"))
    data = sorted((r["k"], r["kind"], r["label"], tuple(r["f"])) for r in made.collect())
    return [r[1] for r in data], np.array([r[3] for r in data]), np.array([r[2] for r in data], dtype=float)


def fit(spark: SparkSession, n: int = TRAINING_ROWS) -> Forest:
    """Fit on ``n`` generated rows and calibrate thresholds on as many held-out ones; once per process."""
    if n not in _FITTED:
        kinds, x, y = _featured(spark, training_rows(n) + training_rows(n, held_out=True))
        bias, trees = boost(x[:n], y[:n])
        scores = bias + np.array([sum(leaf(t, row) for t in trees) for row in x])
        thresholds = {}
        for kind in ALL_KINDS:
            ranked = sorted(((scores[i], y[i]) for i in range(n, len(y)) if kinds[i] == kind), reverse=True)
            thresholds[kind], good = 1e9, 0
            for k, (score, label) in enumerate(ranked, 1):
                good += label
                if good >= PRECISION * k and (k == len(ranked) or ranked[k][0] < score):
                    # between this score and the next, so that rounding decides nothing
                    thresholds[kind] = float((score + ranked[k][0]) / 2 if k < len(ranked) else score)
        _FITTED[n] = Forest(bias, trees, thresholds)
    return _FITTED[n]


_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _meets(spans: str) -> str:
    """SQL: whether ``c`` overlaps one of ``spans``, which are in order and apart: binary search for the last that starts before its end."""
    steps = ", ".join(str(1 << k) for k in reversed(range(28)))
    at = f"aggregate(array({steps}), 0, (n, k) -> CASE WHEN n + k <= size({spans}) AND get({spans}, n + k - 1).start < c.end THEN n + k ELSE n END)"
    return f"(size({spans}) > 0 AND coalesce(get({spans}, {at} - 1).end > c.start, false))"


def candidates(text: str, prefix: str) -> Column:
    """array<struct<kind, start, end, value, before, after>>: what the generators propose outside of base spans."""
    none = "cast(array() AS array<struct<kind:int,start:int,end:int,value:string,before:string,after:string>>)"
    held = _held(text)
    proposed = [f"CASE WHEN {held} RLIKE r'{GENERATOR_NEEDS[k]}' THEN {matches(held, GENERATORS[k], i)} ELSE {none} END" for i, k in enumerate(ALL_KINDS)]
    base = ", ".join(f"'{k}', `{prefix}{k}`" for k in KINDS)
    taken = " OR ".join(_meets(f"b.{k}") for k in KINDS)
    return F.expr(f"transform(array(named_struct({base})), b -> filter(concat({', '.join(proposed)}), c -> NOT ({taken})))[0]")


def selected(found: Column, forest: Forest) -> Column:
    """array<struct<kind, start, end>>, by kind and start: the candidates that the trees select."""
    cuts = F.lit([float(forest.thresholds[k]) for k in ALL_KINDS])

    def judged(s):
        f = features(s["kind"], s["value"], s["before"], s["after"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (F.get(cuts, s["kind"]) - let(f, forest.expression)).alias("rank"))

    good = F.array_sort(F.filter(F.transform(found, judged), lambda s: s["rank"] <= 0))

    def surest(spans):
        """Spans that no surer one overlaps; in order of start, overlapping ones are near each other."""
        near = lambda k: F.slice(spans, F.greatest(k - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1))
        rank = lambda s: F.struct(s["rank"], s["kind"], s["start"])
        return F.filter(spans, lambda s, k: ~F.exists(near(k), lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (rank(o) < rank(s))))

    kept = let(good, lambda spans: F.when(F.size(spans) > 1, surest(spans)).otherwise(spans))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def find_pii(docs: DataFrame, text: str = "text", prefix: str = "__pii_") -> DataFrame:
    """``docs`` with ``{prefix}{kind}`` base spans and ``{prefix}added``, the spans (kind number, start, end) that the trees add."""
    forest = fit(docs.sparkSession)
    base = with_base(docs, text, prefix)
    return base.withColumn(f"{prefix}added", let(candidates(text, prefix), lambda found: F.when(F.size(found) > 0, selected(found, forest)).otherwise(F.array().cast(_SPAN))))


def _base_spans(prefix: str) -> Column:
    """Base spans as (kind number, start, end), by kind and then start."""
    number = lambda i: lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.concat(*[F.transform(f"{prefix}{k}", number(i)) for i, k in enumerate(KINDS)])


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column, reach: Column) -> Column:
    """``text`` with array<struct<start, end, tag>>, in order of start, replaced by tags; overlapping spans become the first's.

    ``reach`` is the greatest end so far, span by span.
    """

    def cut(blocks, start, end):
        """Characters [start, end) of the text, from the blocks that hold them."""
        first = F.floor(start / CUT).cast("int")
        n = F.floor((end - 1) / CUT).cast("int") - first + 1
        return F.when(end <= start, F.lit("")).otherwise(F.substring(F.concat_ws("", F.slice(blocks, first + 1, n)), start % CUT + 1, end - start))

    def made(blocks, reach):
        past = lambda k: F.coalesce(F.get(reach, k - 1), F.lit(0))
        numbered = F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), past(k).alias("past"), s["tag"].alias("tag")))
        heads = F.filter(numbered, lambda s: s["start"] >= s["past"])
        parts = F.transform(heads, lambda s: F.concat(cut(blocks, s["past"], s["start"]), s["tag"]))
        return F.concat(F.concat_ws("", parts), cut(blocks, F.element_at(reach, -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return let(blocks, lambda b: made(b, reach))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pipeline stage: ``docs`` with every span replaced by ``[KIND]``; overlapping spans become the first's placeholder.

    Every row comes back, in its own columns; null texts stay null, empty ones empty; repeated rows are
    redacted each; an empty table gives an empty result.
    """
    p = free_name(docs, "__pii_")
    found = find_pii(docs, text, p)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    tagged = F.transform(F.concat(_base_spans(p), F.col(f"{p}added")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("tag")))
    found = found.withColumn(f"{p}all", F.array_sort(tagged))
    reach = F.expr(running(f"transform({p}all, s -> s.end)", "greatest({a}, {b})"))
    spans = F.struct(F.col(f"{p}all").alias("spans"), reach.alias("reach"))
    clean = let(spans, lambda s: replaced(F.col(f"`{text}`"), s["spans"], s["reach"]))
    return found.withColumn(text, F.when(F.size(f"{p}all") == 0, F.col(f"`{text}`")).otherwise(clean)).select(*[f"`{c}`" for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: counts and spans of personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"__pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    found = found.select("doc_id", *counts, _base_spans("__pii_").alias("base"), F.col("__pii_added").alias("added"))
    everything = F.when(F.size("added") > 0, F.array_sort(F.concat("base", "added"))).otherwise(F.col("base"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(everything).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """:func:`redact` for ``documents``: ``n_chars``, where the table has it, follows the text."""
    out = redact(docs)
    if "n_chars" not in docs.columns:
        return out
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
