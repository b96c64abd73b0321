from tessera.operators import inventory
from tessera.plans.facts import Facts, extract_facts
from tessera.plans.schema import FACTS
from tessera.sources import corpus
from tessera.streaming import scan


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = corpus.sources(spark, sf_dir, "python", "rust")
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.repartition(3).write.parquet(landing)
    for _ in range(2):  # the second run finds nothing new
        scan.append_facts(scan.source_stream(spark, landing, 2), out, state).awaitTermination()
    got = inventory.summary(Facts(spark.read.schema(FACTS).parquet(out)))
    want = inventory.summary(Facts(extract_facts(rows)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_summary(spark, sf_dir, tmp_path):
    rows = corpus.sources(spark, sf_dir, "typescript")
    landing = str(tmp_path / "in")
    rows.repartition(2).write.parquet(landing)
    query = scan.running_summary(scan.source_stream(spark, landing, 1)).writeStream.format("memory").queryName("running").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert spark.table("running").select("lang", "files").first() == ("typescript", rows.count())
    finally:
        query.stop()
