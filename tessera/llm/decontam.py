"""Benchmark decontamination by template canonicalisation (operator 4).

Texts become sequences of template tokens: numbers, names (capitalised words inside a sentence) and
units (after a number) turn into typed placeholders, neighbouring placeholders of one type into one;
all other words are lower-cased.  A second, *case-blind* reading of the same text types numbers and
units only, so that copies in lower case, upper case or title case are read as their originals are.
Windows of ``WINDOW`` template tokens of a document are hash-joined with those of the benchmark,
reading by reading.  Within one alignment of document and item, slot values must be consistent: each
benchmark value stands for one value of the document wherever it occurs.  Windows that disagree with
the majority do not count.  A document leaks an item when the windows of one reading that count cover
at least ``MIN_COVERAGE`` of the item's windows, so verbatim copies, recased copies and questions
asked again with other numbers or names are all found.

Scale: the benchmark's windows are measured first.  Up to ``BROADCAST_BYTES`` of them are broadcast
as the build side of a hash join that runs inside one map over the documents: no shuffle, however
many documents hold the same passage.  Beyond that bound a Bloom filter of fixed size (``BLOOM_BITS``)
is broadcast instead: the documents' windows that pass it are shuffle-joined on the window's hash as
narrow rows (digest of the text, hash, position), items that cannot reach the coverage are dropped,
and the rest are judged on the texts by the very same code, so both ways give the same rows.

Defined results: null or empty texts and items never match; items shorter than a window are one
window of all their tokens; windows with fewer than ``MIN_LITERALS`` ordinary words are not
indexed; items without an id are left out; whether a row leaks depends on its text alone, so rows
that share or lack a doc_id are judged each by its own text (and reported once per doc_id and item,
by the best); an empty benchmark or table gives an empty result; extra columns are ignored by the
query and carried by the stage.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, discard, free_name, kept, map_rows, materialize, small_batches, struct, table, with_key

WINDOW, MIN_LITERALS, MIN_COVERAGE = 8, 5, 0.5
#: Bytes that the windows of a broadcast benchmark may take in a worker; larger benchmarks are shuffle-joined.
BROADCAST_BYTES = 128_000_000
#: Size of the Bloom filter of such a benchmark's windows, and the probes for a window.
BLOOM_BITS, PROBES = 1 << 27, 3
#: Distinguishes the windows of the case-blind reading.
BLIND = 0x5DEECE66D1CE4E5B

# Common units of measure, in their usual spellings.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw v a k c f j kj cal kcal percent pct usd eur gbp dollar dollars euro euros cent cents kmh mph kph km/h m/s".split()
)
_TOKENS = re.compile(r"\d[\d.,:/]*\d|\d|[^\W\d_]+")
_NUMBER, _NAME, _UNIT, _OTHER = (xxhash.xxh64_intdigest(x, 1) >> 4 << 4 for x in ("<number>", "<name>", "<unit>", "<other>"))
#: Low bits of a token code; a token without KNOWN is no literal word of the benchmark.
CAPITAL, ENDS, MEASURE, KNOWN = 1, 2, 4, 8
_WORD_ENDS = frozenset("abcdefghijklmnopqrstuvwxyz,;")
_STOPS = (".", "!", "?", ":")
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64)] * 2


#: What is taken off a chunk before it is looked at as one word.
_EDGES = "\"'()[]{}.,;:!?#$%&*<>|-/\\"


def _coder(words: dict[str, int] | None):
    """chunk -> codes of its tokens: a word's 60-bit hash and its flags.

    With ``words``, the codes of the benchmark's literal words and of units, all other words have one hash.
    """
    digest, units = xxhash.xxh64_intdigest, UNITS

    def hashed(lower: str, _: int) -> int:
        code = digest(lower, 1) >> 4 << 4 | KNOWN
        return code | MEASURE if lower in units else code

    code_of = words.get if words is not None else hashed

    def code(token: str) -> int:
        lower = token.lower()
        if lower != token and token[0].isupper() and (len(token) == 1 or not token.isupper()):
            return code_of(lower, _OTHER) | CAPITAL
        return code_of(lower, _OTHER)

    def codes(chunk: str) -> tuple[int, ...]:
        word = chunk.strip(_EDGES)
        if word.isalpha():
            if chunk[-1] in _WORD_ENDS or chunk.rstrip("\"')]}\u00bb\u201d")[-1:] not in _STOPS:
                return (code(word),)
            return (code(word) | ENDS,)
        found = [_NUMBER | KNOWN if token[0].isdigit() else code(token) for token in _TOKENS.findall(chunk)]
        if found and chunk[-1] not in _WORD_ENDS and chunk.rstrip("\"')]}\u00bb\u201d")[-1:] in _STOPS:
            found[-1] |= ENDS
        return tuple(found)

    return codes


chunk_codes = _coder(None)


def _known(words) -> dict[str, int]:
    """Codes of the benchmark's literal words, and of units."""
    hashed = {word: xxhash.xxh64_intdigest(word, 1) >> 4 << 4 | KNOWN for word in words}
    return hashed | {word: hashed.get(word, _OTHER) | MEASURE for word in UNITS}


def template(codes: np.ndarray, blind: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(template hashes, index of each in ``codes``): placeholders typed and runs of one type merged."""
    plain = codes >> np.uint64(4) << np.uint64(4)
    flags = codes & np.uint64(15)
    out = plain.copy()
    if not blind:
        inside = np.zeros(len(codes), dtype=bool)
        inside[1:] = (flags[:-1] & np.uint64(ENDS)) == 0
        out[((flags & np.uint64(CAPITAL)) > 0) & inside] = _NAME
    measure = np.flatnonzero(flags & np.uint64(MEASURE))
    measure = measure[measure > 0]
    out[measure[plain[measure - 1] == _NUMBER]] = _UNIT
    twice = np.flatnonzero(out[1:] == out[:-1]) + 1
    twice = twice[(out[twice] == np.uint64(_NUMBER)) | (out[twice] == np.uint64(_NAME))]
    index = np.delete(np.arange(len(codes)), twice)
    return out[index], index


def window_hashes(hashes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` template tokens: a polynomial in their hashes, by differences of its running sum."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if len(_powers[0]) <= len(hashes):
        size = 2 * len(hashes) + 1000
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(size, base, dtype=np.uint64)])
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum((hashes ^ (hashes >> np.uint64(29))) * _powers[0][: len(hashes)], out=sums[1:])
    return (sums[width:] - sums[:-width]) * _powers[1][:n]


class Text:
    """One text's template, with slot values on demand."""

    def __init__(self, text: str, codes: np.ndarray, blind: bool = False):
        self.text, self.blind = text, blind
        self.hashes, self.index = template(codes, blind)
        self.values: list[str] | None = None

    def slots(self, at: int, width: int) -> tuple[str, ...]:
        """The raw values of the placeholders in a window."""
        if self.values is None:
            raw = [t.lower() for c in self.text.split() for t in _TOKENS.findall(c)]
            ends = [*self.index[1:].tolist(), len(raw)]
            self.values = [" ".join(raw[a:b]) for a, b in zip(self.index.tolist(), ends)]
        kinds = self.hashes[at : at + width]
        return tuple(self.values[at + k] for k, h in enumerate(kinds.tolist()) if h in (_NUMBER, _NAME, _UNIT))

    def windows(self, width: int) -> np.ndarray:
        found = window_hashes(self.hashes, width)
        return found ^ np.uint64(BLIND) if self.blind else found


def index_items(items: list[tuple]) -> list[tuple]:
    """(hash, width, item_id, position, slot values, windows of the item, reading, words) of every indexed benchmark window.

    The words are all literal ones of the item, once, with its first window.
    """
    rows = []
    for item_id, text in items:
        codes = np.array([c for chunk in (text or "").split() for c in chunk_codes(chunk)], dtype=np.uint64)
        for blind in (False, True):
            made = Text(text or "", codes, blind)
            width = min(WINDOW, len(made.hashes))
            if not width:
                continue
            literal = ~np.isin(made.hashes, np.array([_NUMBER, _NAME, _UNIT], dtype=np.uint64))
            found = made.windows(width).tolist()
            chosen = [p for p in range(len(found)) if literal[p : p + width].sum() >= min(MIN_LITERALS, width)]
            words = sorted({t.lower() for t in _TOKENS.findall(text) if not t[0].isdigit()})
            rows += [(found[p], width, item_id, p, made.slots(p, width), len(chosen), blind, words if p == chosen[0] else []) for p in chosen]
    return rows


def judge(matches: list[tuple[int, int, tuple, tuple]], total: int) -> tuple[int, float, int]:
    """(windows that count, coverage, slots) of one document and item from (document position, item position, item slots, document slots)."""
    by_offset = defaultdict(list)
    for at, position, wanted, got in matches:
        by_offset[at - position].append((position, wanted, got))
    counted: set[int] = set()
    n_slots = 0
    for aligned in by_offset.values():
        votes: dict[str, Counter] = defaultdict(Counter)
        for _, wanted, got in aligned:
            for a, b in zip(wanted, got):
                votes[a][b] += 1
        stands = {a: min(c, key=lambda b: (-c[b], b)) for a, c in votes.items()}
        for position, wanted, got in aligned:
            if all(stands[a] == b for a, b in zip(wanted, got)):
                counted.add(position)
        n_slots = max(n_slots, len(stands))
    return len(counted), len(counted) / max(1, total), n_slots


class Matcher:
    """The build side of the hash join: benchmark windows by hash."""

    def __init__(self, rows: list[tuple]):
        self.by_hash: dict[int, list[tuple]] = defaultdict(list)
        for h, width, item_id, position, slots, total, *_ in rows:
            self.by_hash[h].append((width, item_id, position, slots, total))
        kinds = {(r[6], r[1]) for r in rows}
        self.sorted = {(blind, w): np.array(sorted({r[0] for r in rows if (r[6], r[1]) == (blind, w)}), dtype=np.uint64) for blind, w in kinds}
        self.least = min((w for _, w in kinds), default=0)
        self.cache = WordCache(_coder(_known({word for r in rows for word in r[7]})), 250_000)

    def _may(self, codes: np.ndarray, blind: bool) -> bool:
        """Whether any window can match: so many tokens on end that are words of the benchmark or can be placeholders."""
        out = np.flatnonzero((codes & np.uint64(KNOWN | MEASURE | (0 if blind else CAPITAL))) == 0)
        if not len(out):
            return len(codes) >= self.least
        return bool(max(out[0], len(codes) - 1 - out[-1], np.diff(out).max(initial=1) - 1) >= self.least)

    def leaks(self, text: str | None) -> list[tuple]:
        """(item_id, n_windows, coverage, n_slots) of the items that one whole text leaks."""
        codes = np.fromiter(chain.from_iterable(map(self.cache.__getitem__, (text or "").split())), dtype=np.uint64)
        if not len(codes) or not self.sorted:
            return []
        best: dict = {}
        for blind in (False, True):
            if not self._may(codes, blind):
                continue
            made = Text(text, codes, blind)
            matches: dict = defaultdict(list)
            totals = {}
            for (reading, width), known in self.sorted.items():
                if reading != blind:
                    continue
                hashes = made.windows(width)
                where = np.searchsorted(known, hashes)
                where[where == len(known)] = 0
                for at in np.flatnonzero(known[where] == hashes).tolist():
                    for w, item_id, position, slots, total in self.by_hash[int(hashes[at])]:
                        got = made.slots(at, width)
                        if w == width and len(got) == len(slots):
                            matches[item_id].append((at, position, slots, got))
                            totals[item_id] = total
            for item_id, rows in matches.items():
                n, coverage, slots = judge(rows, totals[item_id])
                if coverage >= MIN_COVERAGE and (coverage, n, slots) > best.get(item_id, (0,)):
                    best[item_id] = (coverage, n, slots)
        return [(item_id, n, coverage, slots) for item_id, (coverage, n, slots) in best.items()]


def _index(benchmark: DataFrame) -> DataFrame:
    """The rows of :func:`index_items` for all items."""
    schema = with_key(benchmark, "item_id", "hash long, width int, position long, slots array<string>, total long, blind boolean, words array<string>")

    def kernel():
        return lambda item_id, text: [(item_id, h - (1 << 64) if h >> 63 else h, w, p, list(s), n, blind, words) for h, w, _, p, s, n, blind, words in index_items([(item_id, text)])]

    return materialize(map_rows(benchmark.where("item_id IS NOT NULL"), ["item_id", "text"], kernel, schema), "decontam-index")


def _bounded(index: DataFrame, most: int) -> list[tuple] | None:
    """The index's rows where a worker's copy takes no more than ``most`` bytes (Python's objects with their heads), else None."""
    slots = F.aggregate(F.concat("slots", "words"), F.lit(0), lambda s, x: s + 4 * F.length(x) + 150)
    size = index.agg(F.sum(F.lit(500) + slots)).first()[0] or 0
    if size > most:
        return None
    return [(r["hash"] % (1 << 64), r["width"], r["item_id"], r["position"], tuple(r["slots"]), r["total"], r["blind"], r["words"]) for r in index.collect()]


def _matcher(spark: SparkSession, rows: list[tuple]):
    name, shared = f"decontam:{uuid.uuid4().hex}", spark.sparkContext.broadcast(rows)
    return lambda: kept(name, lambda: Matcher(shared.value))


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots) of every document and item that it leaks."""
    index = _index(benchmark)
    rows = _bounded(index, broadcast_bytes)
    if rows is not None:
        discard(index)
        schema = _schema(docs, benchmark, "doc_id")
        matcher = _matcher(docs.sparkSession, rows)
        found = map_rows(docs, ["doc_id", "text"], lambda: lambda doc_id, text: [(doc_id, *leak) for leak in matcher().leaks(text)], schema)
    else:
        named = docs.select("doc_id", F.md5("text").alias("digest"))
        found = named.join(_judged(docs, benchmark, index), "digest").drop("digest")
    best = F.max_by(F.struct("n_windows", "coverage", "n_slots"), F.struct("coverage", "n_windows", "n_slots"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _schema(docs: DataFrame, benchmark: DataFrame, key: str):
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return with_key(docs, key, f"item_id {kind}, n_windows long, coverage double, n_slots long")


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    """The Bloom filter's bits of each hash."""
    return [(hashes * np.uint64(pow(_BASE, k + 1, 1 << 64)) >> np.uint64(20)) % np.uint64(BLOOM_BITS) for k in range(PROBES)]


def _bloom(index: DataFrame) -> np.ndarray:
    """One byte array of ``BLOOM_BITS`` bits that every indexed window sets its probes in; one partition's at a time on the driver."""

    def run(batches):
        bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy().astype(np.uint64)):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], type=pa.binary())], names=["bits"])

    whole = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for row in index.select("hash").mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    return whole


def _judged(docs: DataFrame, benchmark: DataFrame, index: DataFrame) -> DataFrame:
    """(digest, item_id, n_windows, coverage, n_slots) for benchmarks beyond the broadcast bound, by digest of the text."""
    spark = docs.sparkSession
    kinds = sorted((r["blind"], r["width"]) for r in index.select("blind", "width").distinct().collect())  # 2 * WINDOW at most
    shared, name = spark.sparkContext.broadcast(_bloom(index)), f"decontam-bloom:{uuid.uuid4().hex}"
    texts = docs.where(F.col("text").isNotNull()).select(F.md5("text").alias("digest"), "text")

    def kernel():
        cache = kept(name, lambda: WordCache(chunk_codes, 250_000))

        def one(digest, text):
            codes = np.fromiter(chain.from_iterable(map(cache.__getitem__, text.split())), dtype=np.uint64)
            for blind, width in kinds if len(codes) else ():
                hashes = np.unique(Text(text, codes, blind).windows(width))
                passed = np.ones(len(hashes), dtype=bool)
                for at in _probes(hashes):
                    passed &= (shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                for h in hashes[passed].astype(np.int64).tolist():
                    yield digest, h, width, blind

        return one

    windows = map_rows(texts, ["digest", "text"], kernel, struct("digest string, hash long, width int, blind boolean"))
    # a window is common where a passage is: its rows are dealt over several tasks, each with the few items that have it
    salts = 16
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)))
    spread = index.select("hash", "width", "blind", "item_id", "position", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    met = dealt.join(spread, ["hash", "width", "blind", "salt"]).groupBy("digest", "item_id", "blind").agg(F.count_distinct("position").alias("n"), F.first("total").alias("total"))
    able = met.where(F.col("n") >= MIN_COVERAGE * F.col("total")).select("digest", "item_id").distinct()
    # a text's candidate items are no more than its windows; they go to one row that has the text
    items = able.join(benchmark.select("item_id", F.col("text").alias("item")), "item_id").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("item_id", "item"))).alias("items"))
    rows = texts.join(items, "digest").groupBy("digest").agg(F.first("text").alias("text"), F.first("items").alias("items"))
    rows = rows.select("digest", "text", F.col("items.item_id").alias("ids"), F.col("items.item").alias("item_texts"))

    def judge_row():
        def one(digest, text, ids, item_texts):
            return [(digest, *leak) for leak in Matcher(index_items(list(zip(ids, item_texts)))).leaks(text)]

        return one

    return map_rows(rows, ["digest", "text", "ids", "item_texts"], judge_row, _schema(texts, benchmark, "digest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose text leaks no item, with the same columns, on either side of the bound.

    Rows without a text stay; rows that share or lack a doc_id, and repeated rows, go or stay each by
    its own text; an empty benchmark keeps all; an empty table gives an empty result.
    """
    index = _index(benchmark)
    rows = _bounded(index, broadcast_bytes)
    if rows is None:
        leak = free_name(docs, "__leak")
        leaking = _judged(docs, benchmark, index).select(F.col("digest").alias(leak)).distinct()
        return docs.join(leaking, F.md5(docs["text"]) == F.col(leak), "left_anti")
    discard(index)
    matcher = _matcher(docs.sparkSession, rows)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        find = matcher().leaks
        return pd.Series([not find(t) for t in texts], dtype=bool)

    return docs.where(clean("text"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every (document, benchmark item) leak."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
