"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that hold together what the given links do."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:  # hook the larger root to the smaller one, then halve paths
        ra, rb = label[a], label[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if np.array_equal(lo, hi):
            break
        np.minimum.at(label, hi, lo)
        while not np.array_equal(label, label[label]):
            label = label[label]
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def contracted(links: DataFrame) -> DataFrame:
    """Each partition's links as stars: no component changes, and there is at most a link for each node and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        rows = 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            rows += batch.num_rows
            if rows > 2_000_000:
                held, rows = [forest(*map(np.concatenate, zip(*held, strict=True)))], 0
        u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, ws: Workspace, rounds: int = 40) -> DataFrame:
    """node, component (its smallest node) of every node that has a link in u, v.

    Alternating large and small stars: each node hands the smallest of its neighbours to the larger ones, then to
    the smaller ones, until all links are stars. Minima are written before the join with the links, so that Spark can
    split the links of a hub. Contraction leaves a link once in each part at most; that it may be in several parts
    changes no minimum, so links are not made distinct by a shuffle of their own.
    """
    now = ws.save(contracted(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")), "links")
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.save(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")).withColumn("m", F.least("m", "u")), "low")
        # settled: every node is a leaf of its smallest neighbour, or a hub below all its neighbours
        if low.filter("m < u and m < top").limit(1).count() == 0:
            ws.drop(now)
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = both.join(low.select("u", "m"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(contracted(large.filter("u <> v")), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ws.save(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        kept = ws.save(contracted(small.filter("u <> v")), "small")
        ws.drop(now, low, large, least)
        now = kept
    raise RuntimeError(f"components did not settle in {rounds} rounds")
