"""Every operator and pipeline stage on odd and on empty tables."""

import pytest

import corpus_pipeline
from tessera.llm import simhash
from tessera.llm.queries import QUERIES

from .conftest import DOCUMENTS, PROSE

ROWS = {"op3_html": 6, "op4_decontaminate": 1, "op6_chat": 5}


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_odd_tables(name, spark, odd_dir):
    query = QUERIES.get(name, corpus_pipeline.run)
    rows = query(spark, odd_dir).collect()
    if name == "op5_packing":
        assert {d for r in rows for d in r["doc_ids"]} == {d for d, t, *_ in DOCUMENTS if t}
    elif name != "pipeline":
        assert len(rows) == ROWS.get(name, len(DOCUMENTS))


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(name, spark, empty_dir):
    query = QUERIES.get(name, corpus_pipeline.run)
    assert query(spark, empty_dir).count() == (1 if name == "op6_chat" else 0)


#: The (doc_id, text) that each stage leaves of the odd table.
LEFT = {
    "quality": [d for d in DOCUMENTS if d[0] == 13],
    # the first of equal texts, one of all without words, one of the two near copies that share an id, and every text like no other
    "near_dedup": [d for d in DOCUMENTS if d[0] in (1, 3) or d[0] not in (1, 2, 3, 4, 5, 13) and d[1]],
    "decontaminate": [d for d in DOCUMENTS if d[0] != 13],
    "pii": DOCUMENTS,
}


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_tables(stage, spark, odd_dir, empty_dir):
    """Nulls, repeated and missing ids, ties, empty and very long texts, clashing names: the very rows that stay, untouched."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, odd_dir)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    if stage == "near_dedup":
        (copy,) = [r["text"] for r in rows if r["doc_id"] == 13]
        assert copy.startswith(PROSE)
        rows = [r for r in rows if r["doc_id"] != 13]
    key = lambda d: (d[0] is None, d[0] or 0, d[1] is None, d[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == sorted(((d[0], d[1]) for d in LEFT[stage]), key=key)
    assert all(r[c] == "clash" for r in rows for c in docs.columns[5:])
    none = spark.read.parquet(f"{empty_dir}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)[stage](spark, none, empty_dir).count() == 0


def test_stages_keep_rows_that_share_or_lack_an_id(spark):
    texts = [" ".join(f"{w}{k}" for w in "alpha beta gamma delta epsilon zeta".split()) for k in range(5)]
    rows = [(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (8, texts[0]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in simhash.deduplicate(docs).collect()]
    assert sorted(left, key=str) == sorted(rows[:5], key=str)
