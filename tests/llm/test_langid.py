import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import regex

from tessera.llm import langid


@pytest.fixture(scope="module")
def model():
    vocabulary = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aba", "c"])}
    prob = np.random.default_rng(1).dirichlet(np.ones(len(vocabulary) + 1), 2).T
    return langid.PieceModel(["x", "y"], prob, vocabulary)


def segmentations(marked, vocabulary):
    if not marked:
        yield []
        return
    for n in range(1, len(marked) + 1):
        piece = vocabulary.get(marked[:n], len(vocabulary) if n == 1 and marked[0] not in vocabulary else None)
        if piece is not None:
            for rest in segmentations(marked[n:], vocabulary):
                yield [piece, *rest]


@pytest.mark.parametrize("word", ["a", "ab", "abab", "cabaab", "zab", "bzzab", "q"])
def test_forward_sums_all_segmentations(model, word):
    want = [sum(math.prod(model.prob[p, k] for p in s) for s in segmentations("▁" + word, model.vocabulary)) for k in range(2)]
    assert np.allclose(np.exp(model.words([word, "abc", word])[0]), want)
    assert np.allclose(np.exp(model.words(["abc", word])[1]), want)


def test_expected_counts_are_posterior_counts(model):
    word = "abab"
    all_ = list(segmentations("▁" + word, model.vocabulary))
    got = model.expected(model.arcs(["▁" + word]), np.array([[3.0, 1.0]]))
    for k, times in ((0, 3.0), (1, 1.0)):
        weights = [math.prod(model.prob[p, k] for p in s) for s in all_]
        want = np.zeros(len(model.vocabulary) + 1)
        for w, s in zip(weights, all_):
            for p in s:
                want[p] += times * w / sum(weights)
        assert np.allclose(got[:, k], want)


def plain_forward(model, word):
    """log P(word | language) by the forward recursion, written out, on numbers that do not underflow."""
    marked, longest = "▁" + word, max(map(len, model.vocabulary))
    out = []
    for k in range(len(model.languages)):
        values = [Fraction(1)]
        for end in range(1, len(marked) + 1):
            total = Fraction(0)
            for start in range(max(0, end - longest), end):
                piece = model.vocabulary.get(marked[start:end], len(model.vocabulary) if end - start == 1 and marked[start] not in model.vocabulary else None)
                if piece is not None:
                    total += values[start] * Fraction(float(model.prob[piece, k])).limit_denominator(10**9)
            values.append(total)
        out.append(float(math.log(values[-1].numerator) - math.log(values[-1].denominator)))
    return out


@pytest.mark.parametrize("n", [38, 39, 40, 41, 79, 80, 81, 250])
def test_runs_of_any_length_are_chained(model, n):
    rng = random.Random(n)
    words = ["".join(rng.choice("aabbcz") for _ in range(k)) for k in (n, 3, n + 45)]
    assert np.allclose(model.words(words), [plain_forward(model, w) for w in words], rtol=1e-6, atol=1e-5)


def test_what_follows_letter_forty_decides():
    english, glued = "the and of that with this is was are", "der und von das mit dies ist war sind"
    fitted = langid.fit({"en": Counter([*english.split(), english.replace(" ", "") * 9]), "de": Counter([*glued.split(), glued.replace(" ", "") * 9])}, langid.pieces())
    german = "derundvondasmitdiesistwarsind" * 110
    (plain, _), (mixed, sure), (spaced, _) = langid.Scorer(fitted).score_all(["the" * 14, "the" * 14 + german, "the " * 5 + german])
    assert (plain, mixed, spaced) == ("en", "de", "de") and sure > 0.99
    # long chunks leave nothing behind
    scorer = langid.Scorer(fitted)
    scorer.score_all([german, "the"])
    assert german not in scorer.word_row and german not in scorer.chunk_row


def test_learned_languages_and_und():
    fitted = langid.fit({"en": Counter("the and of that with this".split()), "de": Counter("der und von das mit dies".split())}, langid.pieces())
    rows = langid.Scorer(fitted).score_all(["that with this", "UND VON DAS!", "", None, "123 ---", "漢"])
    assert [r[0] for r in rows[:2]] == ["en", "de"]
    assert rows[2:5] == [("und", 0.0)] * 3 and rows[5][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in rows)


def test_forgetting_changes_nothing():
    fitted = langid.fit({"en": Counter("the and of".split()), "de": Counter("der und von".split())}, langid.pieces())
    texts = [f"word{chr(97 + i % 26)} the, der. {chr(97 + i % 7) * 3}-x" for i in range(60)]
    small, large = langid.Scorer(fitted, cap=3), langid.Scorer(fitted)
    assert [small.score_all([t])[0][0] for t in texts] == [r[0] for r in large.score_all(texts)]


def test_query_against_plain_scoring(spark, sf_dir):
    """Every document's language and score, from the fitted pieces alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fitted = langid.learn(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    arcs = fitted.automaton
    known = {}

    def word_scores(word):
        if word not in known:
            marked = "▁" + word
            values = np.zeros((len(marked) + 1, len(fitted.languages)))
            values[0] = 1
            at = sorted([(end + 1, v & 255, v >> 8) for end, v in arcs.iter(marked)] + [(i + 1, 1, len(fitted.vocabulary)) for i, c in enumerate(marked) if c not in fitted.letters])
            for end, size, piece in at:
                values[end] += values[end - size] * fitted.prob[piece]
            logs = np.log(values[-1])
            known[word] = np.maximum(logs - logs.max(), -4.0 * max(1.0, len(word) / 12))
        return known[word]

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in langid.op7_langid(spark, sf_dir).collect():
        words = regex.findall(r"\p{L}+", (texts[row["doc_id"]] or "").lower())
        if not words:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        total = sum(word_scores(w) for w in words)
        assert row["lang_pred"] == fitted.languages[int(total.argmax())]
        assert abs(row["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in langid.op7_langid(spark, sf_dir).collect() if r["held_out"]]
    assert len(rows) > 20 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
