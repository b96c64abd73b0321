import random

import numpy as np

from tessera.llm import packing


def naive(lengths, capacity):
    """Best fit decreasing by looking at every open row."""
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [r for r in range(len(rows)) if room[r] >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            r = len(rows)
            rows.append([])
            room.append(capacity)
        rows[r].append(i)
        room[r] -= lengths[i]
    return rows, room


def test_best_fit_is_best_fit():
    rng = random.Random(1)
    for _ in range(50):
        capacity = rng.randint(1, 64)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        want, room = naive(lengths, capacity)
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(room) and len(rows) == len(want)


END = packing.end_of_text(packing.encoder())


def restored(rows, seq_len):
    pieces = {}
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows)
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u2")
        positions = np.frombuffer(r["position_ids"], dtype="<u2").tolist()
        resets = [k for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]) for k in range(b - a)]
        assert positions == resets + [0] * (seq_len - len(resets))
        assert len(ids) == seq_len and r["n_tokens"] == r["cu_seqlens"][-1] and r["n_segments"] == len(r["doc_ids"])
        assert all(i == END for i in ids[r["n_tokens"] :])
        for doc, offset, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            pieces.setdefault(doc, []).append((offset, ids[a:b].tolist()))
    out = {}
    for doc, parts in pieces.items():
        whole = []
        for offset, ids in sorted(parts):
            assert offset == len(whole)
            whole += ids
        out[doc] = whole
    return out


def test_documents_come_back(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    encode = packing.encoder()
    for seq_len, shard in ((2048, packing.SHARD_TOKENS), (64, 5000)):
        rows = packing.pack_documents(docs, seq_len=seq_len, shard_tokens=shard).collect()
        got = restored(rows, seq_len)
        assert got == {d: [*encode.encode_ordinary(t), END] for d, t in texts.items()}
        assert all(encode.decode(ids[:-1]) == texts[d] for d, ids in got.items())
        filled = sum(r["n_tokens"] for r in rows) / (len(rows) * seq_len)
        assert filled > 0.97


def test_widths():
    assert END == 50256 and packing.width(END) == "<u2" and packing.width(1 << 16) == "<u4"
    (row,) = packing.pack_shard([(7, np.array([70_000, 1, 80_000], dtype="<u4"))], 4, 80_000, 5)
    assert row[:4] == (5, 0, 3, 1) and np.frombuffer(row[7], dtype="<u4").tolist() == [70_000, 1, 80_000, 80_000]


def test_shards_are_told_apart_without_ids(spark):
    docs = spark.createDataFrame([(None, "the same text"), (1, "the same text")] * 40, "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, seq_len=16, shard_tokens=32).collect()
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows) > 4


def test_written_rows(spark, sf_dir, tmp_path):
    packed = packing.op5_packing(spark, sf_dir)
    packing.write_packed(packed, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == packed.count()
