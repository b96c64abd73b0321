"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 8).

A document's fingerprint sums the bits of the XXH64 hashes of its word shingles.  Two fingerprints
that differ in at most ``MAX_BITS`` = 2 bits differ in at most 2 of their 8 bytes, so they share
at least 6 *positional bytes*.

Posting lists of single bytes would hold a 256th of the corpus each, and their pairs grow with its
square.  The index therefore posts each distinct fingerprint under conjunctions of four positional
bytes (32 bits): the 14 blocks of four of the 8 positions whose numbers have exclusive or zero.  Any
three positions lie in exactly one of these blocks, so two fingerprints that share 6, 7 or 8
positional bytes meet in 3, 7 or 14 lists, and those that share 5 or fewer in one at most.  The
*tally* counts the lists in which a pair meets: ``MIN_LISTS`` = 3 or more is the guaranteed minimum of
6 shared bytes, no more and no less.  Pairs under it are dropped, the rest verified bit by bit.

Crowded lists (over ``LIST_CAP`` distinct fingerprints: families of close variants) are not paired.
Two words within 2 bits have a word in common within 1 bit of both, so each member is posted under
its own value and its 32 one-bit variants in the bits that the list leaves open: members that meet
are within 2 bits, members within 2 bits meet, and at most 33 members can meet in a posting.
That is exact and linear, and serves only what the cap excludes: a linked pair meets in a crowded
list, where this finds it, or all its lists are short, and the tally is whole.

Scale: equal texts collapse first (``groupBy(fingerprint)`` combines map-side), so a group of
copies is one row whatever its size; fingerprints and postings are 8-16 byte rows; components come
from alternating large-star / small-star contraction with every round written to the shared folder.

Defined results: null or empty text has fingerprint zero and is linked like any other; ties take
the smallest doc_id; repeated doc_ids give one row per input row; null doc_id is kept as a row and
ignored as a representative where another is there; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, free_name, map_rows, materialize, release, struct, table, with_key

SHINGLE, SEED, MAX_BITS = 3, 42, 2
LIST_CAP = 64
#: The blocks of four byte positions that are posted, and in how many of them a linked pair agrees at least.
BLOCKS = tuple(c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)
MIN_LISTS = 3

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    return _fingerprint(_words(text), shingle)


def _fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:])]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=">u8", count=len(grams))
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 15):  # bounds the unpacked bits of very long texts
        ones += np.unpackbits(hashes[start : start + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(grams)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): signed 64-bit fingerprints of all rows."""

    def kernel():
        def one(doc_id, text):
            return [(doc_id, _signed(fingerprint(text, shingle)))]

        return one

    return map_rows(docs, [key, "text"], kernel, with_key(docs, key, "fp long"))


def _mask(block: tuple[int, ...]) -> int:
    return _signed(sum(255 << (8 * p) for p in block))


def index(distinct: DataFrame) -> DataFrame:
    """(slot, bytes, fp, n): postings of ``distinct(fp)`` under the blocks, in lists of n members, two or more."""
    postings = F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for k, c in enumerate(BLOCKS)])
    posted = distinct.select("fp", F.explode(postings).alias("p")).select("fp", "p.slot", "p.bytes")
    lengths = posted.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return posted.join(lengths, ["slot", "bytes"])


def tallied(lists: DataFrame) -> DataFrame:
    """(a, b, lists), a < b: the pairs of the short lists by the number of lists in which they meet, the minimum at least."""
    short = lists.where(F.col("n") <= LIST_CAP).groupBy("slot", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # <= LIST_CAP values
    heads = short.select("fps", F.posexplode("fps").alias("i", "a"))
    pairs = heads.select("a", F.explode(F.slice("fps", F.col("i") + 2, LIST_CAP)).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists")).where(F.col("lists") >= MIN_LISTS)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: fingerprints of ``distinct(fp)`` tied so that components equal those of all links."""
    lists = materialize(index(distinct), "simhash-lists")
    pairs = tallied(lists).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")

    open_bits = F.expr("CASE slot " + " ".join(f"WHEN {k} THEN {~_mask(c)}L" for k, c in enumerate(BLOCKS)) + " END")
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda bit: bit.bitwiseAND(open_bits) != 0)
    near = F.concat(F.array("fp"), F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit)))
    met = lists.where(F.col("n") > LIST_CAP).select("slot", "bytes", "fp", F.explode(near).alias("at"))
    # at most 33 members are within one open bit of ``at``
    met = met.groupBy("slot", "bytes", "at").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    found = materialize(pairs.unionByName(stars).distinct(), "simhash-links")
    discard(lists)
    return found


def named_by_smallest(members: DataFrame, salts: int = 16) -> DataFrame:
    """``members(..., first, root)`` with ``component_id``, the smallest ``first`` of all with that root.

    The few roots of several members are joined salted, so that a component of any size is dealt over
    ``salts`` tasks; all others have their own.
    """
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    dealt = members.withColumn("_salt", F.pmod(F.xxhash64(*members.columns), F.lit(salts)))
    spread = smallest.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(spread, ["root", "_salt"], "left").withColumn("component_id", F.coalesce("component_id", "first")).drop("_salt")


def _settled(edges: DataFrame) -> bool:
    """Whether distinct ``edges(a, b)``, a > b, are stars around smallest nodes: no node has two smaller neighbours, or smaller and larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("n")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("n")))
    # a leaf has one end of its own; a centre has only others'
    ends = ends.groupBy("node").agg(F.sum("n").alias("smaller"), F.min("n").alias("least"))
    return ends.where("smaller > 1 OR smaller = 1 AND least = 0").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): connected components of ``edges(a, b)``, the root being the smallest node.

    Alternates large-star (each node's larger neighbours go to its smallest neighbour) with
    small-star (its smaller neighbours and itself go there), until all components are stars, which
    neither would change.  The driver keeps a record of every query, so there is one check a round.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components-0")
    for turn in range(1, max_rounds):
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = least.select("a", F.col("m").alias("b")).unionByName(moved).where("a <> b").distinct()
        after = materialize(small, f"components-{turn}")
        discard(edges)
        edges = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(fps: DataFrame) -> DataFrame:
    """``fps(doc_id, fp)``, with any more columns, and component_id, the smallest doc_id reachable."""
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    edges = links(classes.select("fp"))
    if edges.isEmpty():
        tied = classes.select("fp", F.col("first").alias("component_id"))
    else:
        roots = components(edges)
        discard(edges)
        labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        tied = named_by_smallest(labelled).select("fp", "component_id")
    return fps.join(tied, "fp").select(*fps.columns, "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprint and component of every document."""
    fps = materialize(fingerprints(table(spark, sf_dir, "documents")), "simhash-fingerprints")
    found = near_duplicates(fps)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies at five words and a similarity of 0.8 ---------------------------------------------
#
# The operator above proposes first: the texts' fingerprints, posted under their positional bytes,
# tallied over the lists, tied into components.  An exact check follows: each member of a component
# is held against its most copied one on the five-word shingles.  On sf0.1 that ties 1 of 48.
#
# Texts that share 0.8 of their shingles can differ in more than 2 of 64 SimHash bits, some 8 on
# average: no byte need agree, and how many do depends on the kind of edit.  Links that the
# fingerprints do not show, or that the check against one member leaves open, are found by prefix
# filtering on the shingles, whatever the edit: with the shingles of all texts in one order, two sets
# of similarity 0.8 or more have a member in common among the first n - ceil(0.8 n) + 1 of each.  Any
# order is right; the shingles that a sample of the texts shows to be common come last, so that a
# common passage makes no long list.
#
# Two bounds, neither of which a linked pair can miss, spare most proposals the verification: by the
# places of the shared shingle, and by a parity sketch (the exclusive or of one bit per shingle),
# whose differing bits never outnumber the shingles that only one of the two texts has.

NEAR_SHINGLE = 5
#: Similarity from which texts are linked, as a fraction: bounds in whole numbers have no rounding.
NUMERATOR, DENOMINATOR = 4, 5
#: The columns of a parity sketch, eight bytes each.
SKETCH = tuple(f"s{i}" for i in range(8))
#: One text in SAMPLED tells which shingles are common: those of COMMON sampled texts or more, COMMONS of them at most.
SAMPLED, COMMON, COMMONS = 16, 4, 100_000
#: Candidate texts whose doc_ids are broadcast (some 24 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000


def _text_hash(words: list[bytes]) -> int:
    """63-bit hash of a text's lower-cased words: equal for exact copies."""
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) >> 1


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 63-bit hashes, in order, of the five-word shingles (the whole sequence where there are fewer words)."""
    digest = xxhash.xxh64_intdigest
    grams = [b"%b %b %b %b %b" % g for g in zip(words, words[1:], words[2:], words[3:], words[4:])] if len(words) > NEAR_SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((digest(g, SEED) >> 1 for g in grams), dtype=np.int64, count=len(grams)))


def sketch(grams: np.ndarray) -> tuple[int, ...]:
    """Parity of the shingles at each of 512 bits, as signed longs."""
    odd = np.bincount(grams & (64 * len(SKETCH) - 1), minlength=64 * len(SKETCH)) & 1
    return tuple(np.packbits(odd.astype(np.uint8)).view(">i8").tolist())


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray) -> list[int]:
    """The first shingles in the order of all texts, so many that a linked text has one of them among its own first."""
    place = np.minimum(np.searchsorted(common, grams), max(len(common) - 1, 0))
    rank = np.where(common[place] == grams, counts[place], 0) if len(common) else np.zeros(len(grams), dtype=np.int64)
    n = len(grams)
    return grams[np.lexsort((grams, rank))[: n - -(-NUMERATOR * n // DENOMINATOR) + 1]].tolist()


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts): the common shingles of a sample of the texts, sorted."""
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    grams = map_rows(sample, ["text"], lambda: lambda text: [(g,) for g in shingle_hashes(_words(text)).tolist()], struct("gram long"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = sorted(map(tuple, counts.orderBy(F.desc("n"), "gram").limit(COMMONS).collect()))
    return np.array([g for g, _ in found], dtype=np.int64), np.array([n for _, n in found], dtype=np.int64)


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, text_hash, fp, size, s0..s7, prefix) of every row; raw is a hash of the text as it stands."""
    common, counts = _common(docs)

    def kernel():
        release()

        def one(doc_id, raw, text):
            words = _words(text)
            grams = shingle_hashes(words)
            return [(doc_id, raw, _text_hash(words), _signed(_fingerprint(words)), len(grams), *sketch(grams), prefix(grams, common, counts))]

        return one

    spec = "raw long, text_hash long, fp long, size long, " + ", ".join(f"{c} long" for c in SKETCH) + ", prefix array<long>"
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("raw"), "text"), ["doc_id", "raw", "text"], kernel, with_key(docs, "doc_id", spec))


def _lists(texts: DataFrame) -> DataFrame:
    """(list, id, size, at, copies): postings of lists with two members or more; ``at`` is the shingle's place in its text."""
    posted = texts.select("id", "size", "copies", F.posexplode("prefix").alias("at", "list"))
    # a window deals the postings out once, where counting and joining would do it twice
    return posted.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("list"))).where("n > 1").drop("n")


def _plausible(left: str, right: str) -> Column:
    """Whether sizes and sketches allow a link: the differing bits bound what only one of the two has."""
    m, n = F.col(f"{left}size"), F.col(f"{right}size")
    bits = sum(F.bit_count(F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))) for c in SKETCH)
    return (F.least(m, n) * DENOMINATOR >= F.greatest(m, n) * NUMERATOR) & (bits * (DENOMINATOR + NUMERATOR) <= (m + n) * (DENOMINATOR - NUMERATOR))


def _within_places(left: str, right: str) -> Column:
    """Whether enough shingles are left from the shared one on, as they must be at the first that two linked texts share."""
    m, n = F.col(f"{left}size"), F.col(f"{right}size")
    left_over = F.least(m - F.col(f"{left}at"), n - F.col(f"{right}at"))
    return left_over * (DENOMINATOR + NUMERATOR) >= (m + n) * NUMERATOR


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, tallied: bool = False) -> DataFrame:
    """The pairs (a, b) of text ids whose five-word shingles reach the similarity; ``tallied`` pairs have been found plausible."""
    if not tallied:
        short = texts.select("id", "size", *SKETCH)
        near = pairs.join(short.toDF("a", *[f"a_{c}" for c in short.columns[1:]]), "a").join(short.toDF("b", *[f"b_{c}" for c in short.columns[1:]]), "b")
        pairs = near.where(_plausible("a_", "b_")).select("a", "b")
    pairs = materialize(pairs, "dedup-pairs")
    if pairs.isEmpty():
        return pairs
    wanted = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(texts.select("id", "first", "raw"), "id"), "dedup-wanted")
    # each text is read from one document that has it; only those texts leave the JVM
    firsts = wanted.select(F.col("first").alias("__first"), F.col("raw").alias("__raw")).distinct()
    bounded = wanted.count() <= BROADCAST_TEXTS
    source = docs.select("doc_id", "text")
    same = source["doc_id"].eqNullSafe(F.col("__first")) & (F.xxhash64(source["text"]) == F.col("__raw"))
    source = source.join(F.broadcast(firsts) if bounded else firsts.hint("shuffle_hash"), same, "left_semi")

    def kernel():
        def one(text):
            words = _words(text)
            return [(_text_hash(words), shingle_hashes(words).tolist())]

        return one

    sets = map_rows(source, ["text"], kernel, struct("id long, grams array<long>"))
    # a text comes once, but for rows that repeat its doc_id too
    grams = materialize(sets, "dedup-grams")
    twice = grams.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if not twice.isEmpty():
        again = grams.join(twice, "id", "left_semi").dropDuplicates(["id"])
        whole = materialize(grams.join(twice, "id", "left_anti").unionByName(again), "dedup-grams")
        discard(grams)
        grams = whole
    both = pairs.join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    found = materialize(both.where(common * (DENOMINATOR + NUMERATOR) >= (F.size("ga") + F.size("gb")) * NUMERATOR).select("a", "b"), "dedup-linked")
    discard(pairs, wanted, grams)
    return found


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """(a, b): each text of a component of fingerprints with the component's most copied text."""
    found = near_duplicates(texts.select(F.col("id").alias("doc_id"), "fp", "copies"))
    # of these the smallest is the most copied, of equally copied ones that of the smallest id
    members = found.select(F.struct((-F.col("copies")).alias("copies"), F.col("doc_id").alias("id")).alias("first"), F.col("component_id").alias("root"))
    hubs = named_by_smallest(members).select(F.col("first.id").alias("id"), F.col("component_id.id").alias("hub")).where("id <> hub")
    return hubs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, component_id): groups of near copies, component_id being the smallest doc_id reachable."""
    return _groups(docs).select("doc_id", "text_hash", "component_id")


def _groups(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, text_hash, root, component_id) of every row.

    Equal texts are one row from the start.  The index of fingerprints proposes first.  Families are
    variants of one text, so each text then tries the most copied text that it meets in any list of
    shingles, where the two are not tied yet.  Where members of a list are still apart, every pair of
    different components is then verified: what is left out is tied already.
    """
    digests = materialize(_digests(docs), "dedup-digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw"))
    texts = digests.groupBy(F.col("text_hash").alias("id")).agg(first.alias("f"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("fp", "size", *SKETCH, "prefix")])
    texts = materialize(texts.select("id", F.col("f.doc_id").alias("first"), F.col("f.raw").alias("raw"), "copies", "fp", "size", *SKETCH, "prefix"), "dedup-texts")
    rows = materialize(digests.select("doc_id", "raw", "text_hash"), "dedup-rows")
    discard(digests)
    lists = materialize(_lists(texts), "dedup-lists")
    wide, texts = texts, materialize(texts.drop("prefix"), "dedup-texts")
    discard(wide)
    centre = lists.groupBy("list").agg(F.max_by(F.struct("id", "size", "at", "copies"), F.struct("copies", -F.col("id"))).alias("c"))
    best = lists.select("list", F.struct("id", "size", "at").alias("p")).join(centre, "list").where("p.id <> c.id").where(_within_places("p.", "c."))
    best = best.groupBy("p.id").agg(F.max_by("c.id", F.struct("c.copies", -F.col("c.id"))).alias("centre"))
    spokes = best.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    shown = _verified(_by_fingerprint(texts), docs, texts)
    ties = _tied(None, shown)
    roots = _roots(texts, ties)
    spokes = spokes.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b").where("root_a <> root_b").select("a", "b")
    more = _verified(spokes, docs, texts)
    ties = _tied(ties, more)
    roots = _roots(texts, ties)
    # the pairs of different components: one side at least is outside the list's largest component
    apart = lists.join(roots, "id")
    counted = apart.groupBy("list", "root").agg(F.count(F.lit(1)).alias("n"))
    major = counted.groupBy("list").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("list", "major")
    apart = materialize(apart.join(major, "list").join(texts.select("id", *SKETCH), "id"), "dedup-apart")
    discard(lists)
    member = F.struct("id", "root", "size", "at", *SKETCH)
    minor = apart.where("root <> major").select("list", "major", member.alias("p"))
    met = minor.join(apart.select("list", member.alias("q")), "list").where("p.root <> q.root AND (q.root = major OR p.id < q.id)")
    met = met.where(_within_places("p.", "q.") & _plausible("p.", "q."))
    rest = met.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
    rest = _verified(rest, docs, texts, tallied=True)
    roots = _roots(texts, _tied(ties, rest))
    grouped = roots.join(texts.select("id", "first"), "id")
    named = materialize(named_by_smallest(grouped).select(F.col("id").alias("text_hash"), "root", "component_id"), "dedup-named")
    discard(apart, shown, more, rest, texts)
    return rows.join(named, "text_hash")


def _tied(ties: DataFrame | None, more: DataFrame) -> DataFrame | None:
    """Components (node, root), or None for none, after ``more(a, b)`` links: the stars so far stand for the links that made them."""
    if more.isEmpty():
        return ties
    return components(more if ties is None else more.unionByName(ties.toDF("a", "b")))


def _roots(texts: DataFrame, ties: DataFrame | None) -> DataFrame:
    """(id, root) of every text."""
    if ties is None:
        return texts.select("id", F.col("id").alias("root"))
    return texts.select("id").join(ties, texts["id"] == ties["node"], "left").select("id", F.coalesce("root", "id").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one row of each group of near copies stays, with the same columns: its smallest doc_id.

    A row is known by doc_id and text, so rows that share or lack a doc_id go by their own groups;
    null ids come last, and of one id the smallest hash of the text comes first.  Texts without words,
    null ones among them, are copies of each other.  Of rows that repeat doc_id and text one stays;
    an empty table gives an empty result.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "raw")
    found = _groups(docs)
    chosen = found.groupBy("root").agg(F.min(row).alias("row")).select("row.doc_id", "row.raw")
    times = found.groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("d"), F.col("raw").alias("r"), "n")
    keep = chosen.join(times, chosen["doc_id"].eqNullSafe(times["d"]) & (chosen["raw"] == times["r"]), "left")
    p = free_name(docs, "__keep_")
    keep = materialize(keep.select(F.col("doc_id").alias(f"{p}id"), F.col("raw").alias(f"{p}raw"), F.coalesce("n", F.lit(1)).alias(f"{p}times")), "dedup-keep")
    # the kept rows' ids and hashes are the build side; texts stream past unsorted
    same = docs["doc_id"].eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(docs["text"]) == F.col(f"{p}raw"))
    kept_rows = docs.join(keep.hint("shuffle_hash"), same, "inner")
    columns = [f"`{c}`" for c in docs.columns]
    once = kept_rows.where(F.col(f"{p}times") == 1).select(*columns)
    if keep.where(F.col(f"{p}times") > 1).isEmpty():
        return once
    # rows that repeat doc_id and text: any one of them, chosen before the shuffle
    again = kept_rows.where(F.col(f"{p}times") > 1).dropDuplicates([f"{p}id", f"{p}raw"]).select(*columns)
    return once.unionByName(again)
