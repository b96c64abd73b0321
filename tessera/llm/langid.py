"""Language identification by segmentation-marginalised unigrams (operator 7).

Each language has a probability for every piece of a fixed public vocabulary.  A word's likelihood
is the sum over *all* its segmentations into pieces, by the forward algorithm; piece probabilities
come from expectation-maximisation with the matching backward pass, on a bounded sample of labelled
texts.  A text is scored over all its words: each word contributes its log-likelihood by language,
floored at ``FLOOR`` nats under the best (and as much again for every further ``FLOOR_LETTERS``
letters), so that a passage in another language, or junk, counts only in proportion to its length.
Runs of letters of any length, as languages without spaces have them, go through the forward
algorithm in steps of ``STEP`` letters, of which each begins with the rescaled values that the one
before has left: every letter and every segmentation counts.

Scale: the fit sees at most ``SAMPLE`` texts a language and ``SAMPLE_ROWS`` altogether, picked by a
hash of doc_id from the narrow columns alone, in two steps, so that no task has all rows of a
language; scoring is one map over the documents without a shuffle.  Words are memoised in a bounded
cache, so a text costs about one look-up a word.

Defined results: null texts and texts without a letter are ``und`` with score 0; if nothing can be
learned every text is ``und``; ties go to the language first in order; of labelled rows that share
doc_id and lang the smallest text is learned from; rows are scored one by one; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import ahocorasick
import numpy as np
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, map_texts, table, with_key

VOCABULARY = "piece_bpe_32k.model"
#: The mark of a word's beginning.
MARK = "\u2581"
#: Labelled texts a language and altogether at most that the fit sees; EM rounds.
SAMPLE, SAMPLE_ROWS, ROUNDS = 300, 20_000, 4
FLOOR, FLOOR_LETTERS = 4.0, 12
#: Letters of a lattice, and words whose lattices are held at once; memory is their product times languages.
STEP, BLOCK = 40, 5_000
#: Chunks longer than this are not memoised.
LONGEST_KEY = 64
_LETTERS = regex.compile(r"\p{L}+")
#: ASCII punctuation and digits that are taken off a chunk before it is looked at as a word.
_EDGES = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"


def pieces(vocabulary: str = VOCABULARY) -> dict[str, int]:
    """Lower-case letter pieces (with the word mark where the vocabulary has it) by number."""
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    good = (n for n in names if regex.fullmatch(r"\u2581?\p{L}*", n))
    return {n: i for i, n in enumerate(dict.fromkeys([MARK, *filter(None, good)]))}


class PieceModel:
    """P(piece | language) as a matrix pieces + 1 x languages; the last row is a letter outside the vocabulary.

    Lattices of many words are computed together: an automaton lists the pieces that end at each
    position, and forward (or backward) values of all words advance one position at a time.
    """

    def __init__(self, languages: list[str], prob: np.ndarray, vocabulary: dict[str, int]):
        self.languages, self.prob, self.vocabulary = languages, prob, vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, number in vocabulary.items():
            self.automaton.add_word(piece, number << 8 | len(piece))
        if vocabulary:
            self.automaton.make_automaton()
        self.letters = {p for p in vocabulary if len(p) == 1}
        self.unknown = len(vocabulary) << 8 | 1
        self.longest = max(map(len, vocabulary), default=1)

    def arcs(self, marked: list[str], shift: list[int] | None = None) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) arrays of all arcs, ordered by end then word, and word lengths; positions are ``shift``ed."""
        flat: list[int] = []
        matches, letters, unknown = self.automaton.iter, self.letters, self.unknown
        for k, m in enumerate(marked):
            base = (k << 6 | shift[k] if shift else k << 6) << 32
            flat += [base + ((end + 1) << 32 | v) for end, v in matches(m)]
            if not letters.issuperset(m):
                flat += [base + ((i + 1) << 32 | unknown) for i, c in enumerate(m) if c not in letters]
        codes = np.array(flat, dtype=np.int64)
        end = codes >> 32 & 63
        codes = codes[np.argsort(end, kind="stable")]
        end = codes >> 32 & 63
        return codes >> 38, end - (codes & 255), end, codes >> 8 & 0xFFFFFF, np.array([len(m) for m in marked])

    @staticmethod
    def _sweep(word, near, at, weights, values, positions) -> None:
        """values[word, at] = sum of values[word, near] * weights over arcs, position by position (arcs grouped by ``at``)."""
        cuts = np.searchsorted(at, positions) if positions[0] < positions[-1] else np.searchsorted(-at, -positions)
        for i, lo in enumerate(cuts):
            hi = cuts[i + 1] if i + 1 < len(cuts) else len(at)
            if lo == hi:
                continue
            w = word[lo:hi]
            heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            values[w[heads], positions[i]] = np.add.reduceat(values[w, near[lo:hi]] * weights[lo:hi], heads, axis=0)

    def forward(self, arcs: tuple[np.ndarray, ...]) -> np.ndarray:
        word, start, end, piece, lengths = arcs
        top = int(lengths.max())
        values = np.zeros((len(lengths), top + 1, len(self.languages)))
        values[:, 0] = 1.0
        self._sweep(word, start, end, self.prob[piece], values, np.arange(1, top + 1) if top > 1 else np.array([1, 2]))
        return values

    def expected(self, arcs: tuple[np.ndarray, ...], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, for words seen ``times`` (words x languages)."""
        word, start, end, piece, lengths = arcs
        forward = self.forward(arcs)
        rows = np.arange(len(lengths))
        order = np.lexsort((word, -start))
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        backward = np.zeros_like(forward)
        backward[rows, lengths] = 1.0
        weights = self.prob[piece]
        self._sweep(word, end, start, weights, backward, np.arange(int(lengths.max()) - 1, -1, -1))
        share = times / forward[rows, lengths]
        used = np.zeros_like(self.prob)
        np.add.at(used, piece, forward[word, start] * weights * backward[word, end] * share[word])
        return used

    def words(self, words: list[str]) -> np.ndarray:
        """log P(word | language), all segmentations summed (words x languages)."""
        out = np.zeros((len(words), len(self.languages)))
        short = [k for k, w in enumerate(words) if len(w) <= STEP]
        if short:
            arcs = self.arcs([MARK + words[k] for k in short])
            out[short] = np.log(self.forward(arcs)[np.arange(len(short)), arcs[4]])
        if len(short) < len(words):
            long = sorted((k for k, w in enumerate(words) if len(w) > STEP), key=lambda k: len(words[k]))
            out[long] = self._chained([MARK + words[k] for k in long])
        return out

    def _chained(self, texts: list[str]) -> np.ndarray:
        """:meth:`words` of texts of any length, in order of length: forward values of the last positions are carried from step to step."""
        reach, sizes = self.longest, np.array([len(t) for t in texts])
        logs = np.zeros((len(texts), len(self.languages)))
        tail = np.zeros((len(texts), reach + 1, len(self.languages)))
        tail[:, reach] = 1.0
        at = first = 0
        while first < len(texts):
            back = min(at, reach)
            shift = reach - back
            word, start, end, piece, _ = self.arcs([t[at - back : at + STEP] for t in texts[first:]], [shift] * (len(texts) - first))
            new = end > reach
            word, start, end, piece = word[new], start[new], end[new], piece[new]
            values = np.zeros((len(texts) - first, reach + STEP + 1, len(self.languages)))
            values[:, : reach + 1] = tail[first:]
            self._sweep(word, start, end, self.prob[piece], values, np.arange(reach + 1, reach + STEP + 1))
            steps = np.minimum(sizes[first:] - at, STEP)
            tail[first:] = np.stack([v[n : n + reach + 1] for v, n in zip(values, steps)])
            scale = tail[first:].max(axis=1)
            tail[first:] /= scale[:, None]
            logs[first:] += np.log(scale)
            at += STEP
            first = int(np.searchsorted(sizes, at, side="right"))
        return logs + np.log(tail[:, reach])


def fit(samples: dict[str, Counter], vocabulary: dict[str, int], rounds: int = ROUNDS) -> PieceModel:
    """EM over word counts by language; long runs of letters are learned from ``STEP`` letters at a time."""
    languages = sorted(samples)
    counts: dict[str, np.ndarray] = {}
    for k, language in enumerate(languages):
        for word, times in samples[language].items():
            for i in range(0, len(word), STEP):
                counts.setdefault(word[i : i + STEP] if i else MARK + word[:STEP], np.zeros(len(languages)))[k] += times
    words = sorted(counts)
    model = PieceModel(languages, np.full((len(vocabulary) + 1, len(languages)), 1.0 / (len(vocabulary) + 1)), vocabulary)
    blocks = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)]
    blocks = [(model.arcs(block), np.array([counts[w] for w in block])) for block in blocks]
    for _ in range(rounds):
        used = sum(model.expected(arcs, times) for arcs, times in blocks) + 0.05
        model.prob = used / used.sum(axis=0)
    return model


class Scorer:
    """Scores whole texts.

    Words have rows in one matrix (log-likelihood by language under the best, and a count); a chunk
    between white space names the row of its word, so "Word," and "word" share one.  Memory is
    bounded: past ``cap`` rows everything is forgotten and learned again, and chunks of more than
    ``LONGEST_KEY`` characters are forgotten at once; neither changes a score.
    """

    def __init__(self, model: PieceModel, cap: int = 250_000):
        self.model, self.cap = model, cap
        self._forget()

    def _forget(self) -> None:
        self.word_row: dict[str, int] = {}
        self.chunk_row: dict[str, int] = {"": 0}
        self.matrix = np.zeros((1, len(self.model.languages) + 1))

    def _add_words(self, words: list[str]) -> None:
        parts = [self.matrix]
        for i in range(0, len(words), BLOCK):
            block = self.model.words(words[i : i + BLOCK])
            floor = FLOOR * np.maximum(1.0, np.array([len(w) for w in words[i : i + BLOCK]]) / FLOOR_LETTERS)
            block = np.maximum(block - block.max(axis=1, keepdims=True), -floor[:, None])
            parts.append(np.hstack([block, np.ones((len(block), 1))]))
        self.word_row.update(zip(words, range(len(self.matrix), len(self.matrix) + len(words))))
        self.matrix = np.concatenate(parts)

    def _add(self, chunks: list[str]) -> None:
        """Rows for chunks that are not known yet; the rare chunk of several words has one of its own."""
        several, plain = [], []
        for chunk in chunks:
            word = chunk.strip(_EDGES).lower()
            if word.isalpha():
                plain.append((chunk, word))
            else:
                several.append((chunk, _LETTERS.findall(word)))
        wanted = {w for _, w in plain}.union(*(ws for _, ws in several))
        self._add_words(list(wanted - self.word_row.keys()))
        rows = self.word_row
        self.chunk_row.update([(c, rows[w]) for c, w in plain])
        made = []
        for chunk, words in several:
            if len(words) > 1:
                made.append(self.matrix[[rows[w] for w in words]].sum(axis=0))
                self.chunk_row[chunk] = len(self.matrix) + len(made) - 1
            else:
                self.chunk_row[chunk] = rows[words[0]] if words else 0
        if made:
            self.matrix = np.concatenate([self.matrix, made])

    def score_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [("und", 0.0)] * len(texts)
        split = [(t or "").split() for t in texts]
        if len(self.matrix) > self.cap or len(self.chunk_row) > 2 * self.cap:
            self._forget()
        new = set().union(*split) - self.chunk_row.keys()
        long = {c for c in new if len(c) > LONGEST_KEY}
        self._add(list(new - long if long else new))
        if long:
            known = Scorer.__new__(Scorer)
            known.__dict__.update(self.__dict__, word_row=dict(self.word_row), chunk_row=dict(self.chunk_row))
            known._add(list(long))
            return known._scores(split)
        return self._scores(split)

    def _scores(self, split: list[list[str]]) -> list[tuple[str, float]]:
        out, row_of, matrix = [], self.chunk_row.__getitem__, self.matrix
        for chunks in split:
            total = matrix[np.fromiter(map(row_of, chunks), dtype=np.int64, count=len(chunks))].sum(axis=0)
            if not total[-1]:
                out.append(("und", 0.0))
                continue
            best = int(total[:-1].argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total[:-1] - total[best]).sum())))
        return out


def learn(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> PieceModel:
    """Fit on at most ``sample`` labelled texts a language of ``docs(doc_id, text, lang)``."""
    narrow = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # first the candidates of each of many buckets, then of the language: no task sees more than those
    narrow = narrow.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(64)))
    for key in (["lang", "bucket"], ["lang"]):
        narrow = narrow.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("k") <= sample)
    chosen = narrow.orderBy("k", "lang").limit(SAMPLE_ROWS).select("doc_id", "lang").distinct()
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    counts: dict[str, Counter] = {}
    for row in texts.collect():  # SAMPLE_ROWS at most
        counts.setdefault(row["lang"], Counter()).update(_LETTERS.findall(row["text"].lower()))
    counts = {language: words for language, words in counts.items() if words}
    return fit(counts, pieces(vocabulary)) if counts else PieceModel([], np.zeros((1, 0)), {})


def predict(docs: DataFrame, model: PieceModel, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    name = f"langid:{uuid.uuid4().hex}"
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prob, model.vocabulary))
    scorer = lambda: kept(name, lambda: Scorer(PieceModel(*shared.value)))
    return map_texts(docs, key, lambda: scorer().score_all, with_key(docs, key, "lang_pred string, score double"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the predicted language of every document, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~F.coalesce(held_out(), F.lit(True))).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", "score")
