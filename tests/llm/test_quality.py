import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered),
    }


@given(st.text(alphabet="ab #|\n\t\x0b\x1c é", max_size=120))
@settings(max_examples=200, deadline=None)
def test_statistics(text):
    got = dict(zip(quality.STAT_NAMES, quality.text_stats(text)))
    assert {k: got[k] for k in brute(text)} == brute(text)


def test_query_on_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = checked = 0
    for row in quality.op1_quality(spark, sf_dir).collect():
        want = brute(texts[row["doc_id"]])
        assert {k: row[k] for k in want} == want
        assert row["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (row["base_failed"] and row["kept"])
        if row["doc_id"] in labels and not row["base_failed"]:
            checked += 1
            right += row["kept"] == bool(labels[row["doc_id"]])
    assert right >= 0.95 * checked


def test_em_finds_who_votes_well():
    # two rules see the defect of a fifth of the corpus, one votes at random
    patterns = {}
    for defect, n in ((True, 200), (False, 800)):
        for noise in (-1, 0):
            patterns[(0, -1 if defect else 0, -1 if defect else 0, noise)] = patterns.get((0, -1 if defect else 0, -1 if defect else 0, noise), 0) + n // 2
    posterior, tables, share = quality.estimate(patterns)
    assert all((p < 0.5) == (votes[1] == -1) for votes, p in posterior.items())
    assert abs(share - 0.8) < 0.1
    assert abs(tables[3][0][0] - tables[3][1][0]) < 0.15


def test_clean_corpus_is_kept():
    posterior, _, _ = quality.estimate({(1, 1, 0, 0): 1000})
    assert posterior[(1, 1, 0, 0)] > 0.9
    assert quality.estimate({})[0] == {}


@pytest.mark.parametrize("n", [49, 50])
def test_filter_keeps_rows_whole(spark, n):
    text = " ".join(f"plain{i}, words" for i in range(n // 2)) + (" end." if n % 2 else "")
    docs = spark.createDataFrame([(1, text, "x")] * 2, "doc_id long, text string, votes string")
    assert quality.quality_filter(docs).collect() == (docs.collect() if n >= 50 else [])
