"""Readers: CSV with a byte-order mark, joined JSON lines, binary shapefiles, versioned bundles, two detection layouts."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, encoding="UTF-8")


def json_lines(spark: SparkSession, path: str, schema: str, allowed: list[str] | None = None) -> DataFrame:
    """Objects of a text file, also where a line joins several; labels outside a list are left out."""
    return split_objects(spark.read.text(path), schema, allowed)


def split_objects(lines: DataFrame, schema: str, allowed: list[str] | None = None) -> DataFrame:
    """Objects of lines (value) that may hold several, with or without a space between."""
    each = lines.select(F.explode(F.split(F.regexp_replace("value", r"\}\s*\{", "}\n{"), "\n")).alias("v"))
    rows = each.select(F.from_json("v", schema).alias("o")).filter("o is not null").select("o.*")
    return rows.filter(F.col("label").isin(*allowed)) if allowed else rows


def bundle(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A written table whose version column must be the one asked for."""
    ok = F.assert_true(F.col("version") == version, F.lit(f"the bundle is not of version {version}"))
    return spark.read.parquet(path).filter(ok.isNull())


def detections(archive: DataFrame, recent: DataFrame) -> DataFrame:
    """Two layouts in one, columns that one lacks NULL."""
    return archive.unionByName(recent, allowMissingColumns=True)


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of .shp files: file, record, parts as arrays of rings of x, y."""
    schema = "path string, record int, rings array<array<struct<x: double, y: double>>>"

    def parse(batches):
        for files in batches:
            rows = []
            for path_, raw in zip(files["path"], files["content"], strict=True):
                at = 100
                while at + 8 <= len(raw):
                    record, words = struct.unpack(">ii", raw[at : at + 8])
                    body = raw[at + 8 : at + 8 + 2 * words]
                    at += 8 + 2 * words
                    if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
                        continue
                    parts, n = struct.unpack("<ii", body[36:44])
                    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
                    xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
                    rows.append((path_, record, [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]))
            yield pd.DataFrame(rows, columns=["path", "record", "rings"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def bands(tall: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row for each pixel from one row for each pixel and band."""
    return tall.groupBy("site", "scene", "r", "c").pivot("band", list(names)).agg(F.first("value"))


def window(px: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Rows and columns of a window: a range filter that reaches the scan."""
    return px.filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def band_asset(assets: str, band: str, aliases: list[str]):
    """The first of a band's names that a map of assets has; an error without any."""
    names = [band, band.upper(), band.lower(), *aliases]
    return F.coalesce(*[F.try_element_at(F.col(assets), F.lit(n)) for n in names], F.raise_error(F.lit(f"no asset for {band}")).cast("string"))
