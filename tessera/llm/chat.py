"""Chat formatting by prefix-target expansion, with DataFrame functions only (operator 6).

A conversation is rendered once: every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  The
rendering only ever appends, so the example of the k-th assistant turn (all preceding turns as
context, only that reply trainable) is a *prefix* of it: an example is (rendered conversation, where
its reply starts, where it ends).  :func:`expand` explodes examples as such spans, so that a
conversation of n turns costs its own length; the query spells out each prompt and target
(:func:`example_rows`) and reads turns and loss back from those rows.

Control strings inside texts are escaped reversibly: ``\\`` is doubled, then ``<|`` becomes ``<\\|``.
An escaped text has no ``<|`` at all, so the markers delimit exactly; unescaping is the two
replacements in reverse order.  A role stands on one line: its line breaks become ``<\\n``, which
no escaped text contains either.

Scale: one grouping by conv_id; a conversation must fit in one row, because its rendering (and the
digest of its turns) is a single string.  Rows are combined from short structs; no row is repeated.

Defined results: null texts and roles are empty; rows of one conversation that share a turn number
are ordered by role, then text; a null turn sorts first; a null conv_id is a conversation of its
own; a conversation without assistant turns has zero examples and an empty loss; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: The conversation that the query adds: control strings as plain text.
PROBE_ID, PROBE_TEXT = -1, "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _head(role: Column) -> Column:
    """A turn's opening; a role is one line, so its own line breaks are escaped too."""
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("<\\n")), F.lit("\n"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, examples): one rendering, and one example per assistant turn of it.

    An example is struct<turn_no, lead, size>: its context is everything before turn ``turn_no`` and
    that turn's opening (``lead`` characters after the start marker); its target, the only text under
    the loss mask, is the ``size`` characters that follow.  Expansion is an explode of this array.
    """
    turn = F.struct("turn", _text("role").alias("role"), _text("text").alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rendered = F.concat_ws("", F.transform("turns", lambda t: F.concat(_head(t["role"]), escape(t["text"]), F.lit(END + "\n"))))
    numbered = F.transform("turns", lambda t, k: F.when(t["role"] == TRAINED_ROLE, F.struct(k.alias("turn_no"), (F.length(_head(t["role"])) - len(START)).alias("lead"), F.length(escape(t["text"])).alias("size"))))
    return turns.select("conv_id", rendered.alias("formatted"), F.array_compact(numbered).alias("examples"))


def expand(rows: DataFrame) -> DataFrame:
    """Prefix-target examples as spans: (conv_id, example, target_start, target_end), one row per assistant turn.

    Offsets (0-based code points of the rendering) are running totals of turn lengths.
    """
    sized = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    sized = sized.withColumn("head", F.length(_head(F.col("role"))).cast("long")).withColumn("body", F.length(escape(F.col("text"))).cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = sized.withColumn("end", F.sum(F.col("head") + F.col("body") + len(END) + 1).over(order) - len(END) - 1)
    trained = F.col("role") == TRAINED_ROLE
    spans = spans.withColumn("example", F.sum(trained.cast("long")).over(order) - 1)
    return spans.where(trained).select("conv_id", "example", (F.col("end") - F.col("body")).alias("target_start"), F.col("end").alias("target_end"))


def materialize_examples(rows: DataFrame) -> DataFrame:
    """(conv_id, example, prompt, target): spans of :func:`expand` spelled out as escaped text."""
    spans = expand(rows).join(format_conversations(rows).select("conv_id", "formatted"), "conv_id")
    return spans.select(
        "conv_id",
        "example",
        F.substring("formatted", F.lit(1), F.col("target_start").cast("int")).alias("prompt"),
        F.substring("formatted", (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int")).alias("target"),
    )


def blocks(formatted: Column) -> Column:
    """The turns of a rendering, each without its start marker."""
    cut = F.split(formatted, r"<\|im_start\|>")
    return F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))


def read_back(turn_blocks: Column) -> Column:
    """array<struct<role, text>> parsed from the blocks of a rendering."""

    def turn(block):
        role = F.substring_index(block, "\n", 1)
        # what follows the role's line, without the end marker and its line break
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 2 - len(END))
        return F.struct(unescape(F.replace(role, F.lit("<\\n"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(turn_blocks, turn)


def probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows of conversation -1."""
    kinds = {c: rows.schema[c].dataType for c in ("conv_id", "turn")}
    made = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, TRAINED_ROLE, PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return made.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in made.columns])


def example_rows(made: DataFrame) -> DataFrame:
    """(conv_id, part, seen, prompt, target): renderings of :func:`format_conversations` expanded, one row per example.

    ``prompt`` holds all preceding turns and the opening of the trained one, ``target`` its text; the
    first ``seen`` turns are in the example before as well.  A closing row a conversation, without a
    target, has the whole rendering, which no example reaches where the last turn is not trained.
    Rows stay where the rendering was made: grouping them by conv_id again takes no shuffle.
    """
    closing = F.struct(F.size("blocks").alias("turn_no"), F.lit(0).alias("lead"), F.lit(None).cast("int").alias("size"))
    cut = made.select("conv_id", "examples", blocks(F.col("formatted")).alias("blocks"))
    rows = cut.select("*", F.posexplode(F.concat("examples", F.array(closing))).alias("part", "e"))
    before = F.concat_ws("", F.transform(F.slice("blocks", F.lit(1), F.col("e.turn_no")), lambda b: F.concat(F.lit(START), b)))
    own = F.get("blocks", F.col("e.turn_no"))
    opening = F.when(F.col("e.size").isNotNull(), F.concat(F.lit(START), F.substring(own, F.lit(1), F.col("e.lead")))).otherwise("")
    return rows.select(
        "conv_id",
        "part",
        F.coalesce(F.get("examples", F.col("part") - 1)["turn_no"] + 1, F.lit(0)).alias("seen"),
        F.concat(before, opening).alias("prompt"),
        F.substring(own, F.col("e.lead") + 1, F.col("e.size")).alias("target"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: each conversation read back from its expanded examples, with its loss mask digested.

    formatted_chars counts the code points of the rendering, of which all examples of the conversation are prefixes.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    expanded = example_rows(format_conversations(rows.unionByName(probe(spark, rows))))
    cut = blocks(F.concat("prompt", F.coalesce(F.concat("target", F.lit(END + "\n")), F.lit(""))))
    read = expanded.select("conv_id", "part", "seen", "target", F.when(F.col("target").isNull(), F.length("prompt")).alias("chars"), cut.alias("cut"))
    turns = read_back(F.slice("cut", F.col("seen") + 1, F.greatest(F.size("cut") - F.col("seen"), F.lit(0))))
    read = read.select("conv_id", "chars", F.struct("part", turns.alias("turns"), unescape(F.col("target")).alias("loss")).alias("p"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("parts"), F.max("chars").alias("chars"))
    whole = whole.select("conv_id", "chars", F.flatten(F.col("parts.turns")).alias("turns"), F.concat_ws("", F.col("parts.loss")).alias("loss"))
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH all_rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), escaped AS (
    SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') AS head, replace(replace(text, '\', '\\'), '<|', '<\|') AS body FROM all_rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
