import pytest
from pyspark.sql import functions as F

from tidemill.operators import events as ev
from tidemill.streaming import flows
from tidemill.tables import read

from .conftest import rows


@pytest.fixture()
def folder(spark, data, tmp_path):
    read(spark, data, "events").orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_equal_batch(spark, data, folder):
    schema = read(spark, data, "events").schema
    live = run(flows.windowed_rates(flows.read_events(spark, folder, schema), "ts", F.col("event_type") == "error"), "rates", "complete")
    batch = ev.sliding_rates(read(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("event_type") == "error", "24 hours", "1 hour", 5, 0.5)
    assert rows(live.select("window.start", "rows", "bad")) == rows(batch.select("start", "rows", "bad"))


def test_episodes_equal_batch(spark, data, folder):
    schema = read(spark, data, "events").schema
    live = run(flows.closed_episodes(flows.read_events(spark, folder, schema).repartition(1), "user_id", "ts", "event_type", "error", "purchase"), "episodes")
    table = read(spark, data, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    batch = ev.episodes(table, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase").filter("state = 'closed'")
    assert live.agg(F.sum("occurrences")).first()[0] == batch.agg(F.sum("occurrences")).first()[0]
    assert rows(live.select("key", "occurrences", "closed")) == rows(batch.select("user_id", "occurrences", "closed"))


def test_once_and_upsert(spark, data, folder, tmp_path):
    schema = read(spark, data, "events").schema
    twice = flows.read_events(spark, folder, schema).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert run(flows.once(twice, "event_id").select("event_id"), "once").count() == read(spark, data, "events").count()
    out = str(tmp_path / "snap")
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).writeStream.foreachBatch(flows.upsert_into(out, "user_id", "event_id")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "snap").iterdir())
    got = spark.read.parquet(f"{out}/{last}")
    assert got.count() == read(spark, data, "events").select("user_id").distinct().count()


def test_sessions(spark, data, folder):
    schema = read(spark, data, "events").schema
    live = run(flows.sessions(flows.read_events(spark, folder, schema), "user_id", "ts", "2 hours"), "sessions", "complete")
    assert live.agg(F.sum("rows")).first()[0] == read(spark, data, "events").count()


def test_pushed_mail_is_parsed_once(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    mails = [dict(message_id="m1", source_id="s", subject="A", text_body="t", from_address="a@x.example", received_at="2026-01-01 10:00:00"), dict(message_id="m1", source_id="s", subject="A", text_body="t", from_address="a@x.example", received_at="2026-01-01 11:00:00"), dict(message_id="m2", source_id="s", subject=" ", text_body="t", received_at="2026-01-01 12:00:00"), dict(message_id="m3", source_id="s", subject="C", html_body="<p>x</p>", received_at="2026-01-01 12:00:00")]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, mails)))
    schema = "message_id string, source_id string, subject string, author string, published_at string, html_body string, text_body string, canonical_url string, from_address string, to_address string, received_at string"
    from pyspark.sql.types import StructType

    got = run(flows.pushed_articles(spark, str(tmp_path / "in"), StructType.fromDDL(schema)), "pushed")
    assert sorted((r["message_id"], r["canonical_url"], r["text"]) for r in got.collect()) == [("m1", "https://x.example/mail/m1", "t"), ("m3", "https://mail.invalid/mail/m3", "x")]
