"""Readers and sinks against files written here."""

import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom.sources import readers, sinks


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes("﻿point_id,v\na,1\nb,\n".encode())
    rows = readers.csv(spark, str(tmp_path / "p.csv"), "point_id string, v int").collect()
    assert [(r.point_id, r.v) for r in rows] == [("a", 1), ("b", None)]


def test_json_lines_joined(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"label": "a", "n": 1}{"label": "b", "n": 2}\n{"label": "c", "n": 3} {"label": "a", "n": 4}\nnot json\n')
    rows = readers.json_lines(spark, str(tmp_path / "v.jsonl"), "label string, n int", ["a", "b"]).collect()
    assert sorted((r.label, r.n) for r in rows) == [("a", 1), ("a", 4), ("b", 2)]


def polygon(number, rings):
    points = [p for r in rings for p in r]
    starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    return struct.pack(">2i", number, len(body) // 2) + body


def test_shapes(spark, tmp_path):
    outer, hole = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    null = struct.pack(">2i", 2, 2) + struct.pack("<i", 0)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + polygon(1, [outer, hole]) + null + polygon(3, [outer]))
    got = {r.record: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in readers.shapes(spark, str(tmp_path / "a.shp")).collect()}
    assert got == {1: [outer, hole], 3: [outer]}


def test_bundle_of_another_version(spark, tmp_path):
    spark.createDataFrame([(1, "v5")], "k int, version string").write.parquet(str(tmp_path / "b"))
    assert readers.bundle(spark, str(tmp_path / "b"), "v5").count() == 1
    with pytest.raises(PySparkException, match="not of version v4"):
        readers.bundle(spark, str(tmp_path / "b"), "v4").collect()


def test_missing_asset(spark):
    df = spark.createDataFrame([({"B04": "x"},)], "assets map<string,string>")
    assert df.select(readers.band_asset("assets", "b04", [])).first()[0] == "x"
    with pytest.raises(PySparkException, match="no asset"):
        df.select(readers.band_asset("assets", "b11", ["swir1"])).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, label string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "k int, label string").count() == 2
    sinks.write_json(df, str(tmp_path / "j"), [str(tmp_path)])
    sinks.write_json(df.filter("k = 1"), str(tmp_path / "j"), [str(tmp_path)])
    assert [tuple(r) for r in spark.read.schema("k int, label string").json(str(tmp_path / "j")).collect()] == [(1, "a")]
    with pytest.raises(PermissionError):
        sinks.write_json(df, str(tmp_path / "x" / ".." / ".." / "j"), [str(tmp_path / "x")])
    sinks.write_labels(df, df.select("k", F.lit("b").alias("label")), "k", "label", ["a", "b"], str(tmp_path / "l"), str(tmp_path / "old"))
    assert {r.label for r in spark.read.parquet(str(tmp_path / "l")).collect()} == {"b"}
    with pytest.raises(PySparkException, match="not one of"):
        sinks.write_labels(df, df.select("k", F.lit("z").alias("label")), "k", "label", ["a", "b"], str(tmp_path / "l"), str(tmp_path / "old"))
    sinks.write_features(df.withColumn("g", F.struct(F.col("k").alias("x"))), str(tmp_path / "f"), "g", "label")
    assert spark.read.text(str(tmp_path / "f")).filter(F.col("value").contains('"Feature"')).count() == 2
    files = sinks.manifest(spark, str(tmp_path / "c") + "/*.csv").collect()
    assert files and all(len(r.sha256) == 64 for r in files)
