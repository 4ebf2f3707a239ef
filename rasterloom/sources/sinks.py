"""Sinks: feature collections, keyed upserts, resumable builds, hashes of written files."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def feature(geometry: Column, *properties: str) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def write_features(df: DataFrame, path: str, geometry: str, *properties: str) -> None:
    """One feature a line; a reader joins lines to a collection, so nothing is gathered in one place."""
    df.select(feature(F.col(geometry), *properties).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, allowed: list[str]) -> None:
    """Rows as JSON lines in place of what was there; Spark's commit makes the replacement whole or not at all.

    Only folders below those allowed are written to, whatever dots a path holds.
    """
    whole = posixpath.normpath(path)
    if not any(whole.startswith(posixpath.normpath(a) + "/") for a in allowed):
        raise PermissionError(f"{path} is outside the folders that may be written")
    df.write.mode("overwrite").json(whole)


def write_labels(table: DataFrame, updates: DataFrame, key: str, column: str, allowed: list[str], path: str, backup: str) -> None:
    """The label table with updates, its former state kept beside it; a label outside the list is an error."""
    ok = F.assert_true(F.col(column).isin(*allowed), F.lit(f"a label is not one of {allowed}"))
    checked = updates.filter(ok.isNull())
    table.write.mode("overwrite").parquet(backup)
    updated(table.sparkSession.read.parquet(backup), checked, key, [column]).write.mode("overwrite").parquet(path)


def updated(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with new values where an update has one."""
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = table.join(u, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def todo(wanted: DataFrame, written: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Work that has not been written in this version."""
    return wanted.join(written.filter(F.col("version") == version).select(*keys), keys, "left_anti")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Each file's SHA-256 and length."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
