"""The pipeline against a brute-force version of its stages on the smallest tables."""


import public_tokenizers
from py4j.protocol import Py4JError
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, common, decontam, quality, simhash

from .test_pii import brute as brute_pii
from .test_simhash import brute_components, shingles


def redacted(text):
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in brute_pii(text)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in quality.op1_quality(spark, sf_dir).collect() if r["kept"]}
    left = sorted((d, t) for d, t in docs.items() if d in kept)
    sets = {t: shingles(t) for _, t in left}
    groups = brute_components(left, lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]))
    left = [(d, t) for d, t in left if groups[d] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    matcher = decontam.Matcher(decontam.index_items(items))
    left = [(d, t) for d, t in left if not matcher.leaks(t)]
    public = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = {d: public.encode(redacted(t), add_special_tokens=False).ids for d, t in left}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want)
    same = sum(got[d] == want[d] for d in want)
    assert same >= 0.98 * len(want)  # the trees may add a span that the base rules lack


def test_workers_hold_no_model_of_another_stage(spark, sf_dir, monkeypatch):
    """Workers live through all stages: near_dedup's own steps let an earlier model go, and the last stage's memos are smaller."""
    kernels, real = [], simhash.map_rows
    monkeypatch.setattr(simhash, "map_rows", lambda df, columns, kernel, schema: kernels.append(kernel) or real(df, columns, kernel, schema))
    simhash._digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    monkeypatch.setattr(common, "_KEPT", {"an earlier step": object()})
    kernels[-1]()
    assert not common._KEPT
    monkeypatch.setattr(bpe, "map_rows", lambda df, columns, kernel, schema: kernels.append(kernel))
    bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kernels[-1]()
    (tokenizer,) = common._KEPT.values()
    assert tokenizer.words.cap == tokenizer.cache.cap == 100_000


def test_driver_gives_freed_memory_back(spark, monkeypatch):
    """Each intermediate has the driver's JVM return freed native memory; a JVM that cannot is asked once."""
    asked, real = [], common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda session: asked.append(real(session)))
    assert common.materialize(spark.range(3), "trimmed").count() == 3
    assert asked == [True]

    class Other:
        tries = 0

        @property
        def sparkContext(self):
            Other.tries += 1
            raise Py4JError("no such operation")

    monkeypatch.setattr(common, "_TRIMS", [True])
    assert not real(Other()) and not real(Other()) and Other.tries == 1
