import hashlib
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pii


def passes_luhn(digits):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and passes_luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(kind, *m.span()) for kind, pattern, good in rules for m in re.finditer(pattern, text) if good(m[0])]


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.with_base(docs)
    out = {}
    for row in found.collect():
        out[row["doc_id"]] = [(k, s["start"], s["end"]) for k in pii.KINDS for s in row[f"__pii_{k}"]]
    return [out[i] for i in range(len(texts))]


def test_base_rules_on_random_texts(spark):
    import random

    rng = random.Random(4)
    pieces = ["a.b@c.d", "@", "x@y", "_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111111", "  ", "-", "+1 (415) 555-2671", "+", "+49", "007", ".", " ", "é\U0001f44d", "1", "999999999999999999999", "01.002.0255.3", "a%b-c@d-e.f-g.h"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(800)]
    assert spans_of(spark, texts) == [brute(t) for t in texts]


@given(st.lists(st.text(alphabet="0123456789.+@ -()aé_", max_size=40), min_size=20, max_size=20))
@settings(max_examples=5, deadline=None)
def test_base_rules_on_any_text(spark, texts):
    assert spans_of(spark, texts) == [brute(t) for t in texts]


def test_query_on_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in pii.op10_pii(spark, sf_dir).collect():
        want = brute(texts[row["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row["spans"].split(","))


def test_trees_add_and_redaction_hides(spark):
    texts = ["call me at phone (415) 555-2671 today", "write to mail jane.doe [at] example [dot] org now", "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "order 2023-10 050 and page 12 345", "visa card 5105 1051 0510 5100 and +1 415 555 2671", "meet at home. later"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[0] == "call me at phone [PHONE] today"
    assert out[1] == "write to mail [EMAIL] now"
    assert out[2] == "host [IP] is up"
    assert out[3] == texts[3] and out[5] == texts[5]
    assert out[4] == "visa card [CARD] and [PHONE]"


def brute_redact(text, spans):
    """Replace (kind, start, end) spans one by one; overlapping ones become the first's."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_query_and_redaction_against_brute_force(spark, sf_dir, tmp_path):
    """Beside the base rules' spans the documents hold quoted credentials, which the trees alone find."""
    named = F.concat(F.coalesce("text", F.lit("")), F.lit(' the token = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('" of, it'))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 5 == 0, named).otherwise(F.col("text")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {d: brute(t) + [("secret", *m.span(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)] for d, t in texts.items()}
    assert sum(k == "secret" for spans in want.values() for k, *_ in spans) > 0
    got = {r["doc_id"]: r["spans"] for r in pii.op10_pii(spark, str(tmp_path)).collect()}
    assert got == {d: ",".join(f"{k}:{a}:{b}" for k, a, b in spans) for d, spans in want.items()}
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs.na.fill("")).collect()} == {d: brute_redact(t, want[d]) for d, t in texts.items()}


def test_trees_are_precise_on_strings_of_another_make(spark):
    rows = pii.training_rows(1500, seed=5, held_out=True)
    forest = pii.fit(spark)
    kinds, x, y = pii._featured(spark, rows)
    scores = forest.bias + np.array([sum(pii.leaf(t, row) for t in forest.trees) for row in x])
    for kind in pii.ALL_KINDS:
        mine = np.array([k == kind for k in kinds])
        chosen = scores[mine] >= forest.thresholds[kind]
        assert y[mine][chosen].mean() >= 0.95 and chosen[y[mine] == 1].mean() >= 0.5


def test_forest_expression_walks_the_trees(spark):
    forest = pii.fit(spark)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, (50, len(pii.FEATURES))).astype(float)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, f array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", forest.expression(F.col("f")).alias("s")).collect()}
    for i, row in enumerate(x):
        assert abs(got[i] - forest.bias - sum(pii.leaf(t, row) for t in forest.trees)) < 1e-9


def test_running_totals_by_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 9, n).tolist() for n in (0, 1, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK, 2000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, v array<int>")
    for row in df.select("v", F.expr(pii.running("v")).alias("sums"), F.expr(pii.running("v", "greatest({a}, {b})")).alias("tops")).collect():
        assert row["sums"] == np.cumsum(row["v"]).tolist()
        assert row["tops"] == np.maximum.accumulate(np.array(row["v"], dtype=int)).tolist()


def test_long_texts_of_many_spans_take_linear_time(spark):
    """A megabyte of addresses, and candidates between them: eight times the text takes nowhere near 64 times as long."""
    took = []
    for n in (5_000, 40_000):
        text = " ".join(f"user{i}@mail{i % 7}.example.com (415) 555-{i % 10_000:04d}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        (row,) = pii.redact(docs).collect()
        took.append(time.perf_counter() - start)
        assert row["text"] == " ".join(["[EMAIL] [PHONE]"] * n)
    assert took[1] < 20 * took[0] + 5


def test_redaction_keeps_columns_and_counts(spark):
    docs = spark.createDataFrame([(1, "a@b.co x", 8, "q"), (2, None, None, None)], "doc_id long, text string, n_chars long, spans string")
    assert [tuple(r) for r in pii.redact_documents(docs).orderBy("doc_id").collect()] == [(1, "[EMAIL] x", 9, "q"), (2, None, None, None)]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = pii.op10_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
