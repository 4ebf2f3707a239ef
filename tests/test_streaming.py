"""The streaming forms give over files what the same rows give at once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rasterloom.streaming import events

DAY = dt.datetime(2024, 1, 1)
ROWS = [("a", DAY + dt.timedelta(days=d), 1.0) for d in (0, 3, 7, 7)] + [("b", DAY, 2.0)]


@pytest.fixture
def stream(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "k string, t timestamp, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def drained(spark, df, tmp_path, mode):
    q = df.writeStream.format("memory").queryName("drained").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return [tuple(r) for r in spark.table("drained").collect()]


def test_gap_sessions(spark, stream, tmp_path):
    got = drained(spark, events.gap_sessions(stream, "k", "t").select("k", "n"), tmp_path, "complete")
    assert sorted(got) == [("a", 2), ("a", 2), ("b", 1)]


def test_without_repeats(spark, stream, tmp_path):
    assert len(drained(spark, events.without_repeats(stream, ["k", "t"], "t"), tmp_path, "append")) == 4


def test_hourly(spark, stream, tmp_path):
    got = drained(spark, events.hourly(stream, "k", "t", "v").select("k", "n", "total"), tmp_path, "complete")
    assert sorted(got) == [("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 2.0)]


def test_upserts(spark, stream, tmp_path):
    def merge(batch, _):
        return batch.groupBy("k").agg(F.sum("v").alias("v"))

    events.upserts(stream, str(tmp_path / "out"), str(tmp_path / "ck"), merge).awaitTermination(60)
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).select("k", "v").collect()) == [("a", 4.0), ("b", 2.0)]
