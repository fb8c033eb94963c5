import json

import pytest
from pyspark.sql import functions as F

from tallyloft.sources import files, manifest, pages
from tallyloft.streaming import streams


def test_manifest_follows_generations_and_fences(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    with pytest.raises(LookupError):
        manifest.read(spark, root)
    for revision in (5, 6, 7):
        manifest.publish(spark.range(revision), root, revision)
    assert manifest.read(spark, root).count() == 7 and manifest.read(spark, root, 7).count() == 7
    assert manifest.read(spark, root, 8, fallback=spark.range(1)).count() == 1
    assert manifest.versions(spark, root) == [2, 3]


def test_feeds_registry_logs_and_reports(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps({"source": "s", "price_lakh": 3.5, "extra": 1, "images": ["a"]}) + "\nbroken\n")
    rows = files.feed(spark, f"file://{tmp_path}/feed.json").filter("source IS NOT NULL").collect()
    assert [(r["source"], r["price_lakh"], r["images"]) for r in rows] == [("s", 3.5, ["a"])]
    reg = files.registry(spark, [{"name": "a", "priority": 3, "brands": ["x"], "note": {"k": 1}}]).first()
    assert (reg["priority"], reg["brands"], reg["metadata"]) == (3, ["x"], {"note": '{"k": 1}'})
    (tmp_path / "run.log").write_text('2026-01-01T00:00 INFO {"n": 1}\nnoise\n2026-01-02T00:00 INFO {"n": 2}\n' + "x" * 70000 + ' {"n": 3}\n')
    assert [r["event"]["n"] for r in files.log_events(spark, f"file://{tmp_path}/run.log", "n int").collect()] == [2, 1]
    df = spark.createDataFrame([(1, "a|b")], "id int, t string")
    assert files.to_markdown(df, "R").splitlines()[-1] == "| 1 | a\\|b |"
    files.to_csv(df, f"file://{tmp_path}/csv")
    files.to_json(df, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 1


def test_paged_source_in_batch_and_stream(spark, tmp_path):
    def fetch(page):
        return [(page, f"car {page}")], page < 6

    spark.dataSource.register(pages.paged_source("test_pages", "page int, title string", fetch, budget=10, step=2))
    assert {r["page"] for r in spark.read.format("test_pages").load().collect()} >= set(range(7))
    stream = spark.readStream.format("test_pages").load()
    q = stream.writeStream.format("memory").queryName("paged").option("checkpointLocation", f"file://{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["page"] for r in spark.table("paged").collect()) == list(range(10))


def test_breaker_and_outbox_over_micro_batches(spark, tmp_path):
    kind = "observation_id long, listing_id long, observed_at timestamp_ntz, negative boolean"
    for i, rows in enumerate([[(1, 1, True), (2, 1, True), (3, 2, True)], [(4, 1, True), (5, 2, False)], [(6, 1, True)]]):
        df = spark.createDataFrame([(o, k, n) for o, k, n in rows], "observation_id long, listing_id long, negative boolean")
        df.select("observation_id", "listing_id", F.lit("2026-01-01").cast("timestamp_ntz").alias("observed_at"), "negative").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    raw = streams.read_stream(spark, f"file://{tmp_path}/in", kind)
    out = streams.drain(streams.breaker_stream(raw), "update", f"file://{tmp_path}")
    got = {r["listing_id"]: (r["streak"], r["circuit"], r["cooldown"]) for r in streams.last_batch(out, ["listing_id"]).collect()}
    assert got == {1: (4, "open", 30), 2: (0, "closed", None)}
    sink = streams.outbox_sink(f"file://{tmp_path}/outbox", ["k"])
    alerts = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    for number, ks in ((0, (1, 2)), (1, (2, 3, 3)), (1, (2, 3, 3))):
        sink(alerts(*ks), number)
    assert sorted(r["k"] for r in spark.read.parquet(f"file://{tmp_path}/outbox").collect()) == [1, 2, 3]


def test_session_and_once_only_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:10:00"), (1, "2026-01-01 05:00:00"), (2, "2026-01-02 00:00:00")], "k int, s string").select("k", F.col("s").cast("timestamp_ntz").alias("at"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    raw = lambda: streams.read_stream(spark, f"file://{tmp_path}/in", rows.schema)
    sessions = streams.drain(streams.session_stream(raw(), "at", ["k"]), "append", f"file://{tmp_path}").collect()
    assert sorted(r["events"] for r in sessions if r["k"] == 1) == [1, 2]
    assert streams.drain(streams.alert_once(raw(), "at", ["k"]), "append", f"file://{tmp_path}").count() == 2
