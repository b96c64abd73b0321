"""Small tables with everything that may go wrong in them."""

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} tail{i % 13}." for i in range(40_000))
SAME = "The same text stands here twice, and again, for all to see. " * 6

PROSE = " ".join(f"{a}{b}{'.' if k % 9 == 8 else ''}" for k, (a, b) in enumerate((a, b) for a in "ba co di fu ga ho ki lu ma no pi ru".split() for b in "len ras tim von sel dar gon mis pet lor wan".split()))

DOCUMENTS = [
    (1, SAME, "en", "a"),
    (2, SAME, "en", "a"),
    (2, SAME, "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (5, " \t\n\x0b\x0c\r ", "fr", "b"),
    (6, LONG, "en", "c"),
    (None, "a text without an id, but with words enough to be seen as one of its own kind here", "en", "c"),
    (None, None, "en", None),
    (7, "\U0001f44d\U0001f3fd 漢字 café \x00\x1c\x1f <|endoftext|> \\ <|im_end|> {x}", None, "d"),
    (8, "x" * 60_000, "en", "d"),
    (9, "1 " * 30_000, "en", "d"),
    (10, "@" * 5_000 + "+" * 5_000 + "." * 5_000, "en", "d"),
    (11, "ＡＢＣ ǅ İstanbul ΣΑΣ ß ﬁ é", "xx", "d"),
    (12, "\n".join(["line"] * 200), "en", "d"),
    (13, PROSE, "en", "d"),
    (13, PROSE + " And more.", "en", "d"),
]
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    # columns whose names the operators use for their own
    + [T.StructField(n, T.StringType()) for n in ("votes", "id", "fp", "root", "grams", "score", "first", "n", "kept", "spans", "item_id", "posterior", "__keep", "__keep_id", "__times", "__pii_t", "__pii_email", "__pii_all", "__tessera_stats", "__tessera_votes", "_salt", "__leak", "digest", "rest", "raw")]
)


def _write(spark, folder, empty):
    rows = [] if empty else [(*d, len(d[1]) if d[1] is not None else None, *["clash"] * (len(SCHEMA) - 5)) for d in DOCUMENTS]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    rows = [] if empty else [(1, 1, 0), (2, 1, None), (4, 0, 1), (6, None, 0), (None, 1, 1), (8, 0, 1), (8, 0, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = [] if empty else [(1, "http://a", None), (2, None, ""), (3, "u", "<p>unclosed <b>bold &amp; &#x41;&copy"), (None, "u", "<<<>>> </p></p> &&& \x00"), (5, "u", "<div>" * 3000 + "deep"), (5, "u", "<article><p>x</p></article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    rows = [] if empty else [(1, None), (2, ""), (None, "some text of no item at all that is long enough"), (3, "short one"), (3, "short one"), (4, PROSE[:400])]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [] if empty else [(1, 0, "user", None), (1, 1, "assistant", "a\\<|b\n"), (1, 1, "assistant", "a\\<|b\n"), (2, None, None, "x"), (None, 3, "assistant", ""), (3, 0, "we\nird", "<|im_end|>"), (3, 1, "assistant", "\\\\<\\|")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("odd") / "t", empty=False)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty") / "t", empty=True)
