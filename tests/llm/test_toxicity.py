import random
import zlib

import numpy as np

from tessera.llm import toxicity


def corpus(n, bad, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiou" if k % 2 else "bcdfghlmnprst") for k in range(rng.randint(2, 8)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_unseen_misspellings_share_character_grams():
    texts, labels = corpus(1200, ["worthless", "stupid", "disgusting", "pathetic"], 1)
    model = toxicity.fit(texts, labels)
    held, marks = corpus(200, ["worthles", "stupidd", "disgustting", "patthetic"], 2)
    scores = np.array([s for (s,) in toxicity.Scorer(model).score_all(held)])
    marks = np.array(marks)
    assert ((scores >= toxicity.THRESHOLD) == marks).mean() >= 0.9
    assert np.mean(scores[marks == 1][:, None] > scores[marks == 0][None, :]) >= 0.98
    assert all(0 <= s <= 1 for s in scores)


def test_long_chunks_count_to_their_end():
    texts, labels = corpus(1200, ["worthless", "stupid", "disgusting", "pathetic"], 1)
    scorer = toxicity.Scorer(toxicity.fit(texts, labels))
    clean = [t for t, y in zip(texts, labels) if not y][:10]
    for glue in (",", "-", "/", "_"):
        for text in clean:
            glued = glue.join(text.split()[:20])
            marked = glue.join([glued, "worthless", "stupid"])
            assert scorer.score_all([marked])[0][0] > scorer.score_all([glued])[0][0]
    long = "".join(chr(0x4E00 + i) for i in range(300))
    assert all(g in " ".join(toxicity.split_words(long)) for g in (long[i : i + 5] for i in range(296)))
    assert toxicity.split_words("a b, " + "c" * 15) == ["a", "b,", "c" * 15]


def test_gradients_are_those_of_the_loss():
    corpus = toxicity._Corpus(["some words here", "others there too"])
    bags, labels, weight = [np.array([0, 2]), np.array([3, 4, 5]), np.array([1])], np.array([1, 0, 0]), np.array([1.0, 0.5, 2.0])
    rng = np.random.default_rng(3)
    emb, out, bias = rng.normal(0, 1, (toxicity.BUCKETS, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)
    loss = lambda: toxicity.gradients(corpus, bags, labels, weight, emb, out, bias)[0]
    _, used, d_emb, d_out, d_bias = toxicity.gradients(corpus, bags, labels, weight, emb, out, bias)
    for values, at, got in ((emb, (used[1], 2), d_emb[1, 2]), (emb, (used[-1], 0), d_emb[-1, 0]), (out, (1, 1), d_out[1, 1]), (bias, 0, d_bias[0])):
        kept, sides = values[at], []
        for change in (1e-5, -1e-5):
            values[at] = kept + change
            sides.append(loss())
        values[at] = kept
        assert abs((sides[0] - sides[1]) / 2e-5 - got) < 1e-6


def test_scorer_equals_a_plain_forward_pass():
    texts, labels = corpus(300, ["worthless", "stupid"], 4)
    model = toxicity.fit(texts, labels)

    def plain(text):
        scores = []
        for word in toxicity.split_words(text):
            raw = ("<" + word.lower().strip(toxicity._TRIM) + ">").encode()
            grams = [raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1)] + [raw]
            scores.append(sum(float(model.bucket_scores[zlib.crc32(g) % toxicity.BUCKETS]) for g in grams) / len(grams))
        if not scores:
            return model.middle
        scores.sort(reverse=True)
        x = [sum(scores[:k]) / len(scores[:k]) for k in (1, 3, 8)] + [np.log(len(scores)), 1.0]
        return 1 / (1 + np.exp(-sum(a * b for a, b in zip(x, model.weights))))

    odd = ["", None, "Word, word WORD?! (word)", "stu" + "-x" * 40 + "/worthless," + "y" * 90, "漢" * 300 + " stupid"]
    for text, (got,) in zip(texts[:50] + odd, toxicity.Scorer(model).score_all(texts[:50] + odd)):
        assert abs(plain(text) - got) < 1e-9


def test_one_class_gives_no_model(spark):
    assert toxicity.fit(["a b"], [1]) is None
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [tuple(r) for r in toxicity.score(docs, None).collect()] == [(1, 0.0)]


def test_query_finds_held_out_rows(spark, tmp_path):
    """Insults and their misspellings on rows that no label was read of."""
    texts, labels = corpus(1200, ["worthless", "stupid", "disgusting", "pathetic", "idiot"], 6)
    held, marks = corpus(1200, ["worthles", "stupidd", "disgustting", "patthetic", "idiott"], 7)
    is_held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, (held if is_held(i) else texts)[i]) for i in range(1200)]
    spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, None, labels[i]) for i in range(1200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, str(tmp_path)).collect()}
    assert all(r["held_out"] == is_held(i) and (r["score"] >= 0.3) == r["predicted"] and 0 <= r["score"] <= 1 for i, r in rows.items())
    toxic = [rows[i]["predicted"] for i in range(1200) if is_held(i) and marks[i]]
    clean = [rows[i]["predicted"] for i in range(1200) if is_held(i) and not marks[i]]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.1
    assert rows[5000]["predicted"] == rows[5001]["predicted"] == 0


def test_query_on_documents(spark):
    """Of the generated documents at sf0.1, nine in ten held-out toxic ones are found, and one clean one in a hundred is flagged at most."""
    docs = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, docs).where("held_out").join(spark.read.parquet(f"{docs}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) >= 0.9
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) <= 0.01
