"""Toxicity from subword-bag embeddings under a linear softmax (operator 2).

A word is the mean of the embeddings of its character n-grams (hashed), so a misspelling shares
most of its vector with the word it hides.  A *bag* is the mean of some words' vectors; a linear
softmax over two classes reads it.  Embeddings and softmax are trained jointly, in numpy.  Labels are
on texts, of which a few words make one toxic: training alternates between picking each text's most
toxic words under the current model as its bag (random bags of clean texts beside them) and
refitting; the first picks go by how often n-grams occur in texts of either class.

A mean under a linear layer is a mean of word scores, so a trained model is one number per n-gram
bucket and a text costs one memo look-up a word.  A text's score is a logistic function of the means
of its one, three and eight most toxic words and of its length, fitted on texts that the bags' model
had not seen (``FOLDS`` models beside the final one), so that what the model knows by heart does not
shift the threshold.

Scale: the fit sees at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` labelled texts, picked by a hash of
doc_id from the narrow labels table; scoring is one map over the documents without a shuffle.

Defined results: null and empty texts, which have no words, get the score of a
middling clean text; a doc_id labelled twice
counts as toxic if any label says so, and of a doc_id with several texts the smallest is learned
from; with labels of one class only, or none, every score is 0; rows are scored one by one; long
chunks are scored in pieces to their end; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, kept, map_texts, table, with_key

#: Bounds of the labelled sample, n-gram sizes, buckets, embedding width, words of a bag.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 1800
GRAMS, BUCKETS, WIDTH, BAG = (3, 4, 5), 1 << 16, 8, 6
ROUNDS, EPOCHS, RATE, FOLDS = 2, 3, 0.05, 2
THRESHOLD = 0.3
#: Random bags of a clean text in one round of training; the numbers of top words whose means a text is judged by.
RANDOM_BAGS, POOLS = 3, (1, 3, 8)

_TRIM = "\"'()[]{}.,;:!?#$%&*<>|-_/\\"


#: Bytes of a word at most; longer chunks are words in pieces, cut ones overlapping by a character less than the longest n-gram.
LONGEST = 62
_BREAKS = re.compile("[!-/:-@\\[-`{-~\u2010-\u2027\u2030-\u205e\u3000-\u303f\uff01-\uff0f]+")


def split_words(text: str | None) -> list[str]:
    """Words of a whole text: its white-space chunks, long ones split at punctuation and then by length."""
    words = (text or "").split()
    if not words or max(map(len, words)) * 4 <= LONGEST:
        return words
    return [piece for w in words for piece in (_pieces(w) if len(w) * 4 > LONGEST else (w,))]


def _pieces(word: str) -> list[str]:
    plain = word.lower().strip(_TRIM)
    if len(plain.encode("utf-8", "surrogatepass")) <= LONGEST:
        return [word]
    out = []
    for part in filter(None, _BREAKS.split(plain)):
        width = LONGEST // max(len(c.encode("utf-8", "surrogatepass")) for c in part)
        if len(part.encode("utf-8", "surrogatepass")) <= LONGEST:
            out.append(part)
        else:
            step = width - max(GRAMS) + 1
            out += [part[i : i + width] for i in range(0, max(len(part) - max(GRAMS) + 1, 1), step)]
    return out or [""]


def word_buckets(word: str) -> list[int]:
    """Hashed n-grams of a trimmed, lower-cased word with its borders, and the word itself."""
    plain = word.lower().strip(_TRIM)
    raw = f"<{plain}>".encode("utf-8", "surrogatepass")
    grams = [raw[i : i + n] for n in GRAMS for i in range(len(raw) - n + 1)]
    grams.append(raw)
    return [crc32(g) & (BUCKETS - 1) for g in grams]


class Model:
    """Bucket scores, and the calibration of a text's pooled word scores."""

    def __init__(self, bucket_scores: np.ndarray, weights: np.ndarray, middle: float):
        self.bucket_scores, self.weights, self.middle = bucket_scores, weights, middle
        self._scores = bucket_scores.tolist()

    def word(self, word: str) -> float:
        buckets = word_buckets(word)
        return sum(map(self._scores.__getitem__, buckets)) / len(buckets)

    def text(self, scores: np.ndarray) -> float:
        """The score of a text with these word scores."""
        return float(_sigmoid(pooled(scores) @ self.weights)) if len(scores) else self.middle


def pooled(scores: np.ndarray) -> np.ndarray:
    """What a text is judged by: means of its highest word scores, its length, and one."""
    top = np.sort(scores)[::-1][: max(POOLS)]
    return np.array([*(top[:k].mean() for k in POOLS), np.log(len(scores)), 1.0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Corpus:
    """Training texts as word numbers; words as padded bucket lists in CSR form."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in split_words(t)], dtype=np.int64) for t in texts]
        lists = [word_buckets(w) for w in number]
        self.sizes = np.array([len(x) for x in lists], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if lists else np.zeros(0, np.int64)
        self.buckets = np.array([b for x in lists for b in x], dtype=np.int64)

    def word_scores(self, bucket_scores: np.ndarray) -> np.ndarray:
        return np.add.reduceat(bucket_scores[self.buckets], self.starts) / self.sizes

    def expand(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, position in words) of every n-gram of every word."""
        sizes = self.sizes[words]
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.buckets[self.starts[words][owner] + inner], owner


def gradients(corpus: _Corpus, bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray):
    """(loss, buckets, their embeddings' gradient, that of ``out``, that of ``bias``) of the weighted cross entropy of bags (arrays of word numbers)."""
    sizes = np.array([len(bag) for bag in bags])
    words = np.concatenate(bags)
    bag_of = np.repeat(np.arange(len(bags)), sizes)
    bucket, owner = corpus.expand(words)
    share = 1.0 / (corpus.sizes[words][owner] * sizes[bag_of][owner])
    row = bag_of[owner]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    hidden = np.add.reduceat(emb[bucket] * share[:, None], heads, axis=0)
    logits = hidden @ out + bias
    probs = np.exp(logits - logits.max(axis=1, keepdims=True))
    probs /= probs.sum(axis=1, keepdims=True)
    loss = -(weight * np.log(probs[np.arange(len(bags)), labels])).mean()
    error = probs
    error[np.arange(len(bags)), labels] -= 1
    error *= weight[:, None] / len(bags)
    used, place = np.unique(bucket, return_inverse=True)
    d_hidden = error @ out.T
    step = np.stack([np.bincount(place, d_hidden[row, k] * share, minlength=len(used)) for k in range(emb.shape[1])], axis=1)
    return loss, used, step, hidden.T @ error, error.sum(axis=0)


def _train(corpus: _Corpus, bags: list[np.ndarray], labels: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray, rng) -> None:
    """Joint Adagrad on embeddings and softmax over bags."""
    grad_emb, grad_out = np.full(len(emb), 1e-2), np.full(out.shape, 1e-2)
    toxic = max(1, int(labels.sum()))
    weight = np.where(labels == 1, 0.5 * len(labels) / toxic, 0.5 * len(labels) / max(1, len(labels) - toxic))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 512):
            chosen = order[at : at + 512]
            _, used, step, d_out, d_bias = gradients(corpus, [bags[i] for i in chosen], labels[chosen], weight[chosen], emb, out, bias)
            grad_out += d_out**2
            out -= RATE * d_out / np.sqrt(grad_out)
            bias -= RATE * d_bias
            grad_emb[used] += (step**2).mean(axis=1) * 1e4
            emb[used] -= RATE * 100 * step / np.sqrt(grad_emb[used])[:, None]


def _first_scores(corpus: _Corpus, texts: list[int], y: np.ndarray) -> np.ndarray:
    """Bucket scores to begin with: log odds of the texts of either class that have an n-gram, once (half) or more often (whole)."""
    seen = np.zeros((2, BUCKETS))
    for i in texts:
        used, times = np.unique(corpus.expand(corpus.docs[i])[0], return_counts=True)
        seen[y[i], used] += np.minimum(times, 2) / 2
    n = np.bincount(y[texts], minlength=2)
    support = seen.sum(axis=0)
    return (np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))) * support / (support + 3)


def _fit_bags(corpus: _Corpus, texts: list[int], y: np.ndarray, seed: int) -> np.ndarray:
    """Bucket scores learned from the numbered texts."""
    rng = np.random.default_rng(seed)
    bucket_scores = _first_scores(corpus, texts, y)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = np.stack([-np.ones(WIDTH), np.ones(WIDTH)], axis=1) / np.sqrt(WIDTH), np.zeros(2)
    for _ in range(ROUNDS):
        scores = corpus.word_scores(bucket_scores)
        bags, marks = [], []
        for i in texts:
            words = corpus.docs[i]
            bags.append(words[np.argsort(-scores[words], kind="stable")[:BAG]])
            marks.append(y[i])
            if not y[i]:
                bags += [words[rng.integers(0, len(words), BAG)] for _ in range(RANDOM_BAGS)]
                marks += [0] * RANDOM_BAGS
        _train(corpus, bags, np.array(marks), emb, out, bias, rng)
        bucket_scores = emb @ (out[:, 1] - out[:, 0])
    return bucket_scores


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    """Train on labelled texts; None where a class is missing."""
    pairs = [(t, y) for t, y in zip(texts, labels) if t and t.split()]
    y = np.array([b for _, b in pairs], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    corpus = _Corpus([t for t, _ in pairs])
    # every class in every fold, as far as there are texts of it
    fold = np.zeros(len(y), dtype=np.int64)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    features = np.zeros((len(y), len(POOLS) + 2))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        learned = _fit_bags(corpus, (rest if 0 < y[rest].sum() < len(rest) else np.arange(len(y))).tolist(), y, seed + 1 + k)
        scores = corpus.word_scores(learned)
        for i in np.flatnonzero(fold == k):
            features[i] = pooled(scores[corpus.docs[i]])
    weights = _calibrate(features, y)
    return Model(_fit_bags(corpus, list(range(len(y))), y, seed).astype(np.float32), weights, float(np.median(_sigmoid(features[y == 0] @ weights))))


def _calibrate(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on pooled features, whose last is one (Newton steps, classes as they come)."""
    spread = np.r_[features[:, :-1].std(axis=0) + 1e-9, 1.0]
    middle = np.r_[features[:, :-1].mean(axis=0), 0.0]
    z = (features - middle) / spread
    ridge = np.r_[np.full(z.shape[1] - 1, 0.5), 1e-6]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = _sigmoid(z @ w)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    out = w / spread
    out[-1] -= (out * middle).sum()
    return out


class Scorer:
    """Scores texts; a chunk and the word in it are memoised apart, so "Word," and "word" share the n-grams' work."""

    def __init__(self, model: Model):
        self.model = model
        self.words = WordCache(model.word, 150_000)
        self.cache = WordCache(self._chunk, 200_000)

    def _chunk(self, chunk: str) -> float:
        """A chunk's score, or not a number where it is words in pieces."""
        if len(chunk) * 4 > LONGEST and _pieces(chunk) != [chunk]:
            return math.nan
        return self.words[chunk.lower().strip(_TRIM)]

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        scores = np.fromiter(map(self.cache.__getitem__, words), dtype=np.float64, count=len(words))
        if math.isnan(scores.sum()):
            words = split_words(text)
            scores = np.fromiter((self.words[w.lower().strip(_TRIM)] for w in words), dtype=np.float64, count=len(words))
        return self.model.text(scores)

    def score_all(self, texts: list[str | None]) -> list[tuple[float]]:
        return [(self.score(text),) for text in texts]


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of ``labels(doc_id, toxic)`` with the texts of ``docs(doc_id, text)``."""
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(marked.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])  # one a doc_id of the sample
    return fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row."""
    if model is None:
        return docs.select(f"`{key}`", F.lit(0.0).alias("score"))
    name = f"toxicity:{uuid.uuid4().hex}"
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket_scores, model.weights, model.middle))
    scorer = lambda: kept(name, lambda: Scorer(Model(*shared.value)))
    return map_texts(docs, key, lambda: scorer().score_all, with_key(docs, key, "score double"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the toxicity of every document, learned from labels of rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels.where(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
