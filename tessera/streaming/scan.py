"""Source files as a stream: facts are appended as files arrive, summaries follow them.

The same extraction as a batch scan, under Structured Streaming: offsets and commits in the
checkpoint folder make each file's facts appear exactly once, also after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import inventory
from ..plans.facts import Facts, Settings, extract_facts
from ..plans.schema import SOURCE


def source_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """Rows of SOURCE from Parquet files that land in ``folder``, a bounded number of files a batch."""
    return spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", max_files).parquet(folder)


def facts_stream(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One FACTS row per source row of a stream."""
    return extract_facts(sources, settings)


def append_facts(sources: DataFrame, folder: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Append facts to Parquet in ``folder`` until everything available now is in."""
    facts = facts_stream(sources, settings)
    return facts.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_summary(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts by language over everything so far: a streaming aggregation whose state is one row a language."""
    return inventory.summary(Facts(facts_stream(sources, settings)))


def running_markers(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Task markers by language and tag over everything so far."""
    rows = facts_stream(sources, settings).select("lang", F.explode("markers").alias("m"))
    return rows.groupBy("lang", "m.tag").agg(F.count(F.lit(1)).alias("count"))
