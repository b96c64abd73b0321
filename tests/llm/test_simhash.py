import random

import pytest
import xxhash

from tessera.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    parent = {k: k for k, _ in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if linked(x, y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k, _ in items}


def test_query_on_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    want = brute_components(sorted(prints.items()), lambda x, y: (x ^ y).bit_count() <= 2)
    rows = simhash.op8_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


@pytest.mark.parametrize("cap", [1, 3, 64])
def test_families_of_close_fingerprints(spark, monkeypatch, cap):
    """Crowded lists take the exact other way; both give the components of all links."""
    monkeypatch.setattr(simhash, "LIST_CAP", cap)
    rng = random.Random(5)
    prints, n = [], 0
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.append((n := n + 1, x))
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    assert got == brute_components(prints, lambda x, y: (x ^ y).bit_count() <= 2)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_tally_over_posting_lists_is_the_filter(spark):
    """Pairs that share 4 or 5 positional bytes meet in lists, and only the tally drops them; 6 bytes are 3 lists, 7 are 7."""
    rng = random.Random(8)
    pairs = []
    for wrong in (1, 2, 3, 4) * 30:
        x, y = rng.getrandbits(64), 0
        y = x
        for position in rng.sample(range(8), wrong):
            y ^= rng.randrange(1, 256) << (8 * position)
        pairs.append((wrong, *sorted((signed(x), signed(y)))))
    distinct = spark.createDataFrame([(v,) for _, a, b in pairs for v in (a, b)], "fp long")
    lists = simhash.index(distinct)
    met = {(r["a"], r["b"]) for r in lists.alias("l").join(lists.selectExpr("slot", "bytes", "fp AS b"), ["slot", "bytes"]).where("fp < b").selectExpr("fp AS a", "b").distinct().collect()}
    assert any(wrong in (3, 4) and (a, b) in met for wrong, a, b in pairs)
    got = {(r["a"], r["b"]): r["lists"] for r in simhash.tallied(lists).collect()}
    assert got == {(a, b): {1: 7, 2: 3}[wrong] for wrong, a, b in pairs if wrong <= 2}


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_near_copies(spark):
    """Families of edited copies: groups are those of all pairs at 0.8, and unrelated texts stay apart."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows = []
    for family in range(8):
        base = [word() for _ in range(150)]
        for copy in range(6):
            words = list(base)
            for _ in range(copy // 2):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows) + 1, (" ".join(words)).capitalize()))
    rows += [(len(rows) + 1 + i, " ".join(word() for _ in range(80))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    similar = lambda x, y: len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))
    want = brute_components(rows, similar)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copy_groups(docs).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)
    assert all(want[got[k]] == want[k] for k in want)  # nothing is joined that should not be
    kept = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert kept == set(got.values())


def test_large_family_uses_its_commonest_text(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] * 3
    for _ in range(40):
        words = list(base)
        words[rng.randrange(200)] = f"z{rng.random()}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_copy_groups(docs).collect()} == {0}


def test_crowded_family_tries_all_pairs(spark):
    """Each of a family's unlike branches has its own pairs: none is left out where branches share the lists."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for branch in range(150):  # branches share words, but too few shingles to be tied to each other
        words = list(base)
        for i in rng.sample(range(0, 200, 5), 9):
            words[i] = f"b{branch}x{i}"
        for copy in range(2):
            own = list(words)
            for i in rng.sample(range(200), 2):
                own[i] = f"c{branch}x{copy}x{i}"
            rows.append((len(rows), " ".join(own)))
    sets = {t: shingles(t) for _, t in rows}
    want = brute_components(rows, lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]))
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copy_groups(docs).collect()}
    assert 120 < len(set(want.values())) < 240 and got == want


@pytest.mark.parametrize("long", [60, 300])
def test_every_kind_of_edit(spark, long):
    """Copies with words appended, cut off, put in as a block or changed here and there: each pair at 0.8 or more is found."""
    rng = random.Random(long)
    rows = []
    for part in (0.02, 0.1, 0.14, 0.17, 0.19):
        for kind in range(4):
            for _ in range(5):
                base = [f"u{rng.getrandbits(40):x}" for _ in range(long)]
                n, at = int(part * long), rng.randrange(long)
                new = [f"v{rng.getrandbits(40):x}" for _ in range(n)]
                edited = (base + new, base[: long - n], base[:at] + new + base[at:], [w if rng.random() > part / 9 else "x" for w in base])[kind]
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edited))]
    sets = {t: shingles(t) for _, t in rows}
    alike = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    want = {k: rows[k - 1][0] if k % 2 and alike(rows[k - 1][1], t) else k for k, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) < 0.8 * len(rows) and got == want


def test_fingerprint_index_proposes_near_copies(spark, monkeypatch):
    """Without any posting of shingles the index of fingerprints ties the copies within 2 bits; alike fingerprints of unlike texts are not tied."""
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        base = [f"u{rng.getrandbits(40):x}" for _ in range(600)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, "end"]))]
    line = " ".join(f"l{i}" for i in range(21))
    for _ in range(2):  # a line repeated decides both fingerprints, and few of the distinct shingles
        rows.append((len(rows), " ".join([line] * 200 + [f"v{rng.getrandbits(40):x}" for _ in range(100)])))
    prints, sets = {k: brute_fingerprint(t) for k, t in rows}, {k: shingles(t) for k, t in rows}
    close = lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2
    alike = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    assert close(80, 81) and not alike(80, 81)
    pairs = [(k, k + 1) for k in range(0, 80, 2)]
    shown = [p for p in pairs if close(*p)]
    assert 10 < len(shown) < 40 and all(alike(*p) for p in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copy_groups(docs).collect()}
    assert got == {k: min(k, k - k % 2) if k < 80 else k for k, _ in rows}
    lists = simhash._lists
    monkeypatch.setattr(simhash, "_lists", lambda texts: lists(texts).where("false"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copy_groups(docs).collect()}
    assert got == {k: dict((b, a) for a, b in shown).get(k, k) for k, _ in rows}


def test_rows_that_share_or_lack_an_id(spark):
    text = lambda seed: " ".join(f"w{random.Random(f'{seed}{i}').getrandbits(30)}" for i in range(60))
    near = text("a").rsplit(" ", 2)[0] + " other end"
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, near), (1, text("c")), (1, text("d")), (1, text("c")), (2, text("d")), (3, text("e")), (3, text("f")), (4, text("e")), (None, text("f"))]
    out = [tuple(r) for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    first = [r for r in out if r in ((None, text("a")), (None, near))]
    assert len(first) == 1
    assert sorted(r for r in out if r[0]) == sorted([(1, text("c")), (1, text("d")), (3, text("e")), (3, text("f"))])
    assert [r for r in out if r[0] is None and r not in first] == [(None, text("b"))]


def test_broadcast_and_join_agree(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, simhash.near_copy_groups(docs).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_TEXTS", 0)
    assert sorted(map(tuple, simhash.near_copy_groups(docs).collect())) == one


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_components_in_few_queries(spark):
    """Components are those of a search, whatever the graph; what is settled already costs one write and one check, as the driver keeps every query."""
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(40)]
    mixed = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(9, 9), (8, 7), (7, 8)]
    stars = [(hub, hub + k) for hub in (1000, 2000, 3000) for k in range(1, 20)]
    for pairs in (path, mixed, stars, stars + [(1001, 1002)], stars + [(1000, 2000)], [(5, 1), (5, 2)], [(1, 5), (5, 9)], []):
        edges = spark.createDataFrame(pairs, "a long, b long")
        before = executions(spark)
        found = simhash.components(edges)
        used = executions(spark) - before
        linked = {frozenset(p) for p in pairs}
        nodes = sorted({x for p in pairs for x in p})
        want = brute_components([(x, x) for x in nodes], lambda x, y: frozenset((x, y)) in linked)
        assert sorted(map(tuple, found.collect())) == sorted((x, r) for x, r in want.items() if x != r)
        if pairs in (stars, []):
            assert used <= 2


def test_groups_without_links_need_few_queries(spark):
    """Texts that share shingles with no other propose no pair, so nothing is read or checked for pairs."""
    rows = [(k, " ".join(f"u{k}x{i}" for i in range(80))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = executions(spark)
    found = simhash.near_copy_groups(docs)
    used = executions(spark) - before
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(k, k) for k, _ in rows}
    assert used <= 22
