"""The same operators straight on tables: clone groups, inventories, markers and links of texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_exact_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, count, first_doc): texts that occur more than once, ignoring indentation and blank lines.

    Only a digest per document is shuffled, combined before the shuffle.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hashed = _table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5(F.array_join(lines, "\n")), 1, 16).alias("hash")).where("hash IS NOT NULL")
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("first_doc")).where("count > 1")


def doc_line_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, files, lines, longest): line counts of documents by source."""
    rows = _table(spark, sf_dir, "documents").select("source", F.size(F.split("text", "\n")).cast("long").alias("n"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"), F.max("n").alias("longest"))


def doc_secret_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, hints): documents that assign a quoted literal to something named like a secret."""
    found = F.regexp_count("text", F.lit(r"(?i)(password|passwd|secret|token|api_?key) *= *\"[^\" ]{8,}\""))
    return _table(spark, sf_dir, "documents").select("doc_id", found.cast("long").alias("hints")).where("hints > 0")


def page_link_indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, count, pages): links by target, and the pages that have them."""
    links = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("href=\"([^\"]*)\""), F.lit(1))).alias("target"))
    per_page = links.groupBy("target", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("target").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("pages"))


def page_host_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, count): pages by host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1)
    return _table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("count"))


SQL = {
    "doc_exact_clones": r"SELECT substring(md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))), 1, 16) AS hash, count(*)::BIGINT AS count, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "doc_line_inventory": "SELECT source, count(*)::BIGINT AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, max(len(string_split(text, chr(10))))::BIGINT AS longest FROM documents GROUP BY source",
    "doc_secret_hints": r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key) *= *"[^" ]{8,}"'))::BIGINT AS hints FROM documents WHERE regexp_matches(text, '(?i)(password|passwd|secret|token|api_?key) *= *"[^" ]{8,}"')""",
    "page_link_indegree": r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) SELECT target, count(*)::BIGINT AS count, count(DISTINCT page_id)::BIGINT AS pages FROM l GROUP BY target""",
    "page_host_frequency": "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, count(*)::BIGINT AS count FROM pages GROUP BY 1",
}
