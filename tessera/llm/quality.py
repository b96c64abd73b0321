"""Quality rules as weak supervision (operator 1).

Each document gets a handful of cheap text statistics; a set of *rules* turns them into votes
(+1 good, -1 bad, 0 abstain).  No rule is trusted by itself: expectation-maximisation over the
table of vote patterns estimates, for each rule, how it votes on good and on bad documents, and
the posterior probability of "good" given all the votes decides.

Scale: statistics are one map over the documents, written once (about 60 bytes a document).
The corpus is then summarised by vote pattern, at most ``3 ** len(RULES)`` rows whatever the
input, which is what the driver sees; posteriors return as a broadcast table of that bounded size.

Defined results: null or empty text is a document of zero words (base_failed, not kept, posterior
of its votes); repeated doc_ids are scored row by row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, small_batches, struct, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_POSTERIOR = 0.5
#: The prior of a good document, the strength of priors as a share of the corpus, and EM rounds.
PRIOR_GOOD, PRIOR_WEIGHT, ROUNDS = 0.85, 0.05, 60
#: A rule's prior distribution of votes (bad, abstain, good) on bad and on good documents.
VOTES_ON_BAD, VOTES_ON_GOOD = (0.45, 0.45, 0.10), (0.03, 0.47, 0.50)

STATS = struct(
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper_words long, n_marked_words long, n_digit_words long, n_distinct_words long, n_stops long"
)
STAT_NAMES = [f.name for f in STATS]

_SPACE_BYTES = [c.encode() for c in " \t\n\x0b\x0c\r"]
_STRIP = " \t\n\x0b\x0c\r"


def repeated_positions(words: list) -> int:
    """Words that lie in some 3-word window which occurs twice or more in the sequence."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def text_stats(text: str | None) -> tuple:
    """The statistics of one whole text, in the order of :data:`STATS`."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() separates at exactly the six ASCII white-space bytes
    lines = [line for line in text.split("\n") if line.strip(_STRIP)]
    tally = Counter(words)
    distinct = len(tally)
    upper = marked = digits = stops = 0
    for word, times in tally.items():
        if len(word) > 1 and word.isupper():
            upper += times
        if not word[-1:].isalnum() and word[-1] < 128 and word[-1:] not in b".,;:?!)\"'":
            marked += times
        elif len(word) > 2 and word.endswith(b"!!"):
            marked += times
        if word[-1:] in b".,;:?!":
            stops += times
        if word[:1].isdigit():
            digits += times
    return (
        len(words),
        len(text) - sum(raw.count(c) for c in _SPACE_BYTES),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_positions(words),
        len(lines),
        upper,
        marked,
        digits,
        distinct,
        stops,
    )


@F.pandas_udf(STATS)
def _stats_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    release()
    for batch in texts:
        yield pd.DataFrame([text_stats(t) for t in batch], columns=STAT_NAMES)


#: The column that holds the statistics; documents may have columns of any other name.
_S = "__tessera_stats"


def _c(name: str):
    return F.col(f"{_S}.{name}")


def _share(part: str, whole: str = "n_words"):
    return _c(part) / F.greatest(_c(whole), F.lit(1))


def _vote(bad, good):
    """-1 where ``bad``, +1 where ``good``, else 0."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict:
    """Rule name -> vote expression over the statistics.

    A rule that looks for one defect says nothing of texts without it, so it abstains there;
    only ``length`` and ``prose`` can vote good.
    """
    enough, never = _c("n_words") >= 20, F.lit(False)
    mean_word = _c("word_chars") / F.greatest(_c("n_words"), F.lit(1))
    return {
        "length": _vote(_c("n_words") < MIN_WORDS, _c("n_words") >= 120),
        "prose": _vote(never, enough & _share("n_stops").between(0.02, 0.4) & (_share("n_upper_words") < 0.2) & (_share("n_symbols", "word_chars") < 0.03)),
        "symbols": _vote(_share("n_symbols", "word_chars") > 0.08, never),
        "marked_words": _vote(_share("n_marked_words") > 0.25, never),
        "repeats": _vote(_c("n_repeat_words") > 0.4 * _c("n_words"), never),
        "dup_lines": _vote((_c("n_lines") > 3) & (_share("n_dup_lines", "n_lines") > 0.4), never),
        "shouting": _vote(enough & (_share("n_upper_words") > 0.5), never),
        "word_length": _vote((mean_word < 2.0) | (mean_word > 14.0), never),
        "digits": _vote(_share("n_digit_words") > 0.4, never),
        "variety": _vote((_c("n_words") >= 100) & (_share("n_distinct_words") < 0.08), never),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list, float]:
    """EM over (vote pattern -> documents): posterior of "good" by pattern, rule tables, share of good.

    Votes are independent given the class (naive Bayes).  Dirichlet priors worth ``PRIOR_WEIGHT``
    of the corpus fix which class is the good one and keep rules that never vote well defined.
    """
    total = sum(patterns.values())
    if not total:
        return {}, [], PRIOR_GOOD
    width = len(next(iter(patterns)))
    prior = PRIOR_WEIGHT * total
    good_share, tables = PRIOR_GOOD, [(list(VOTES_ON_BAD), list(VOTES_ON_GOOD)) for _ in range(width)]

    def posterior(votes: tuple[int, ...]) -> float:
        log_odds = math.log(good_share) - math.log1p(-good_share)
        for (on_bad, on_good), v in zip(tables, votes):
            log_odds += math.log(on_good[v + 1]) - math.log(on_bad[v + 1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds))))

    ordered = sorted(patterns.items())
    for _ in range(rounds):
        weights = [(votes, n, n * posterior(votes)) for votes, n in ordered]
        good = sum(g for _, _, g in weights)
        good_share = min(0.999, (good + prior * PRIOR_GOOD) / (total + prior))
        for k in range(width):
            on_bad = [prior * p for p in VOTES_ON_BAD]
            on_good = [prior * p for p in VOTES_ON_GOOD]
            for votes, n, g in weights:
                on_good[votes[k] + 1] += g
                on_bad[votes[k] + 1] += n - g
            # a rule may be uninformative but not perverse: a bad vote is never evidence of good
            bad, fine = [x / sum(on_bad) for x in on_bad], [x / sum(on_good) for x in on_good]
            if fine[0] > bad[0]:
                fine[0] = bad[0] = (fine[0] + bad[0]) / 2
            tables[k] = (bad, fine)
    return {votes: posterior(votes) for votes, _ in ordered}, tables, good_share


_VOTES, _POSTERIOR = "__tessera_votes", "__tessera_posterior"


def with_votes(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics and the vote pattern; only the text visits Python."""
    small_batches(docs.sparkSession)
    voted = docs.withColumn(_S, _stats_udf("text"))
    return voted.withColumn(_VOTES, F.concat_ws(",", *[vote.cast("string") for vote in rules().values()]))


def pattern_posteriors(voted: DataFrame) -> DataFrame:
    """Fit EM to all rows of ``voted``: (votes, posterior), at most 3 ** len(rules()) rows."""
    counts = {tuple(map(int, r[0].split(","))): r[1] for r in voted.groupBy(_VOTES).agg(F.count(F.lit(1))).collect()}
    posteriors, _, _ = estimate(counts)
    return voted.sparkSession.createDataFrame([(",".join(map(str, v)), p) for v, p in posteriors.items()], f"{_VOTES} string, {_POSTERIOR} double")


def with_verdict(voted: DataFrame, posteriors: DataFrame) -> DataFrame:
    """Join the bounded posterior table; adds base_failed and kept inside the statistics struct."""
    failed = (_c("n_words") < MIN_WORDS) | (100 * _c("n_repeat_words") > MAX_REPEAT_PERCENT * _c("n_words"))
    joined = voted.join(F.broadcast(posteriors), _VOTES, "left")
    kept = ~failed & (F.coalesce(F.col(_POSTERIOR), F.lit(0.0)) >= KEEP_POSTERIOR)
    return joined.withColumn(_S, F.col(_S).withField("base_failed", failed).withField("kept", kept))


def quality_filter(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that the method keeps, with the same columns.

    Two passes over the text (patterns, then verdicts): statistics are recomputed rather than
    stored beside a second copy of every text, so the stage needs no disk and no shuffle.

    Null and empty texts have no words and go; rows are judged one by one by their text, so repeated
    rows and rows that share or lack a doc_id stay or go together; an empty table gives an empty result.
    """
    posteriors = pattern_posteriors(with_votes(docs.select("text")))
    # other columns travel in one struct, whatever their names
    rest = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    kept = with_verdict(with_votes(docs.select(rest.alias("rest"), "text")), posteriors).where(f"`{_S}`.kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the verdict on every document, from one pass over the texts."""
    voted = materialize(with_votes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-votes")
    scored = with_verdict(voted, pattern_posteriors(voted))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return scored.select("doc_id", *[_c(f).alias(f) for f in fields], F.col(_POSTERIOR).alias("posterior"), F.col(_VOTES).alias("votes"))
