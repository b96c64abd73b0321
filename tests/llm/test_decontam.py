import collections
import re

import pytest

from tessera.llm import decontam

ITEM = "A farmer in Ohio sells 12 boxes of apples to Maria for 30 dollars each week. How much money does Maria pay the farmer after 4 weeks of buying every box of apples"
FILLER = "Nothing of this has to do with any question that was ever asked anywhere. "


def found(spark, texts, items=((1, ITEM),), **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, **more).collect()}


TEXTS = [
    FILLER * 3 + ITEM + ". " + FILLER,  # verbatim
    FILLER + ITEM.replace("12", "250").replace("30", "7").replace("4 weeks", "19 weeks") + ".",  # other numbers
    FILLER + ITEM.replace("Ohio", "Kenya").replace("Maria", "Otto") + ".",  # other names, one for one
    FILLER * 5,
    "How much money does it take. " + FILLER,
    None,
    "",
    ITEM.lower(),
    FILLER + ITEM.upper() + ". " + FILLER,
    FILLER + ITEM.title() + ". " + FILLER,
]
LEAKING = {0, 1, 2, 7, 8, 9}


@pytest.mark.parametrize("bound", [0, decontam.BROADCAST_BYTES])
def test_templates(spark, bound):
    """The broadcast join and the shuffled one find the same: copies, recased copies, other numbers, other names."""
    assert found(spark, TEXTS, broadcast_bytes=bound) == {(k, 1) for k in LEAKING}


@pytest.mark.parametrize("bound", [0, decontam.BROADCAST_BYTES])
def test_stage_judges_row_by_row(spark, bound):
    """Rows that share or lack a doc_id go or stay by their own text, whatever the benchmark's size."""
    rows = [(1, TEXTS[0], "a"), (1, TEXTS[3], "b"), (2, TEXTS[4], "c"), (None, TEXTS[1], "d"), (None, TEXTS[3], "e"), (None, None, "f"), (3, TEXTS[3], "g"), (3, TEXTS[3], "h"), (4, "", "i"), (5, TEXTS[9], "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, ITEM), (None, TEXTS[3]), (2, None)], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench, broadcast_bytes=bound)
    assert kept.columns == docs.columns
    assert sorted(r["item_id"] for r in kept.collect()) == ["b", "c", "e", "f", "g", "h", "i"]
    none = bench.where("false")
    assert decontam.decontaminate(docs, none, broadcast_bytes=bound - 1).count() == len(rows)
    assert decontam.decontaminate(docs.where("false"), bench, broadcast_bytes=bound).count() == 0


def test_inconsistent_slots_do_not_count():
    same = [(i, i, ("maria",), ("otto",)) for i in range(6)]
    mixed = [(i, i, ("maria",), (name,)) for i, name in enumerate(("otto", "anna", "otto", "lea", "otto", "kim"))]
    assert decontam.judge(same, 6) == (6, 1.0, 1)
    assert decontam.judge(mixed, 6)[0] == 3


def brute_reading(text, blind):
    """[(literal word or placeholder, raw value)] of a text, by the rules alone."""
    tokens = []
    for chunk in (text or "").split():
        own = re.findall(r"\d[\d.,:/]*\d|\d|[^\W\d_]+", chunk)
        ends = chunk.rstrip("\"')]}\u00bb\u201d")[-1:] in ("." "!" "?" ":") and chunk.rstrip("\"')]}\u00bb\u201d") != ""
        tokens += [(t, ends and k + 1 == len(own)) for k, t in enumerate(own)]
    out = []
    for k, (token, _) in enumerate(tokens):
        kind = token.lower()
        if token[0].isdigit():
            kind = "<number>"
        elif kind in decontam.UNITS and k and tokens[k - 1][0][0].isdigit():
            kind = "<unit>"
        elif not blind and k and not tokens[k - 1][1] and token != kind and token[0].isupper() and (len(token) == 1 or not token.isupper()):
            kind = "<name>"
        if out and kind in ("<number>", "<name>") and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + " " + token.lower())
        else:
            out.append((kind, token.lower()))
    return out


def brute_leaks(text, item):
    kinds = ("<number>", "<name>", "<unit>")
    for blind in (False, True):
        doc, own = brute_reading(text, blind), brute_reading(item, blind)
        width = min(8, len(own))
        places = [p for p in range(len(own) - width + 1) if sum(k not in kinds for k, _ in own[p : p + width]) >= min(5, width)] if width else []
        at = collections.defaultdict(list)
        for i in range(len(doc) - width + 1):
            at[tuple(k for k, _ in doc[i : i + width])].append(i)
        aligned = collections.defaultdict(list)
        for p in places:
            for i in at[tuple(k for k, _ in own[p : p + width])]:
                aligned[i - p].append((p, [(a[1], b[1]) for a, b in zip(own[p : p + width], doc[i : i + width]) if a[0] in kinds]))
        counted = set()
        for windows in aligned.values():
            votes = collections.defaultdict(collections.Counter)
            for _, slots in windows:
                for a, b in slots:
                    votes[a][b] += 1
            stands = {a: sorted(c.items(), key=lambda x: (-x[1], x[0]))[0][0] for a, c in votes.items()}
            counted |= {p for p, slots in windows if all(stands[a] == b for a, b in slots)}
        if places and len(counted) >= 0.5 * len(places):
            return True
    return False


def test_query_against_brute_force(spark, sf_dir, tmp_path):
    """All (document, item) pairs of the smallest tables, some passages recased and with other numbers."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    items |= {1000 + k: f"{ITEM} {w} and {w} or {k} others" for k, w in enumerate(("red apples", "Green pears", "OLD plums"))}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    changes = (str.upper, str.title, str.lower, str.swapcase, lambda t: re.sub(r"\d+", "77", t))
    for k, (i, item) in enumerate(sorted(items.items())):
        texts[100_000 + i] = FILLER + changes[k % len(changes)](item) + ". " + FILLER
        texts[200_000 + i] = FILLER + " ".join(item.split()[: len(item.split()) // 2]) + ". " + FILLER
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(d, i) for d, t in texts.items() for i, item in items.items() if brute_leaks(t, item)}
    assert {(100_000 + i, i) for k, i in enumerate(sorted(items)) if k % len(changes) < 3} <= want
    assert {(r["doc_id"], r["item_id"]) for r in decontam.op4_decontaminate(spark, str(tmp_path)).collect()} == want


def test_placeholders():
    import numpy as np

    hashes = lambda t: decontam.template(np.array([c for w in t.split() for c in decontam.chunk_codes(w)], dtype=np.uint64))[0].tolist()
    assert hashes("it took Anna Maria 12 km") == hashes("it took Bob 7,500 miles")
    assert hashes("it took Anna") != hashes("it took anna")
    assert hashes("Anna took it. Then it took") == hashes("anna took it. then it took")
    assert hashes("LOUD WORDS HERE") == hashes("loud words here")
