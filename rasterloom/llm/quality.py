"""Quality classifier (4): random Fourier features over document statistics, ridge scores, isotonic calibration.

One pass over whole texts gives a row of statistics for each document. Random Fourier features approximate a Gaussian
kernel over them; each partition sums its part of the normal equations, and the sums, whose size does not depend on
the rows, meet on the driver. Scores of a calibration fold that the fit did not see are binned and made monotone by
pooling adjacent violators, which turns a score into a probability.

Labels come only from rows that `trainable` lets through, at most `most_rows` of them by hash (a documented bound on
the fit alone; every document is scored). Null and empty texts have all statistics 0 and a score like any other row.
Null labels are not learnt from. Repeated labels of a document count each. Without labels the score is 0.5. Ties are
kept: equal statistics give equal scores. Language, source and ids are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace, as_bytes, slices

MARKS = b".,|!%#$*&-_/\\<>{}[]()=+:;'\"?@~^"
CLASSES = 8 + len(MARKS)
FEATURES, RIDGE, SEED, MOST_ROWS, BINS, PARTS = 384, 1e-4, 7, 500_000, 2000, 32
N_STATS = CLASSES + 10


def classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line feed, other control, lead and trail of UTF-8, marks."""
    of = np.full(256, 5, np.int64)
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = 0, 1, 2
    of[32], of[10], of[192:], of[128:192] = 3, 4, 6, 7
    for i, c in enumerate(MARKS):
        of[c] = 8 + i
    return of


BYTE_CLASS = classes()


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each text, from all its bytes."""
    lens = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = np.repeat(np.arange(len(texts)) * CLASSES, lens)
    share = np.bincount(at + BYTE_CLASS[buf], minlength=len(texts) * CLASSES).reshape(-1, CLASSES) / np.maximum(lens, 1)[:, None]
    rest = np.zeros((len(texts), N_STATS - CLASSES))
    for i, t in enumerate(texts):
        if not t:
            continue
        words, lines = t.split(), t.split(b"\n")
        n = max(1, len(words))
        sizes = list(map(len, words))
        mean = sum(sizes) / n
        rest[i] = (
            np.log1p(len(t)), np.log1p(len(words)), mean, np.sqrt(sum(x * x for x in sizes) / n - mean * mean + 1e-9),
            len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), np.log1p(len(lines)),
            max(sizes, default=0) ** 0.5, sum(len(zlib.compress(t[a : a + (1 << 15)], 1)) for a in range(0, len(t), 1 << 15)) / (len(t) + 32),
        )
    return np.hstack([np.sqrt(share), rest])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(as_bytes(part.column("text"))).astype(np.float32)
                flat = pa.array(x.ravel(), pa.float32())
                col = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), flat)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "x": col})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<float>")


def matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), N_STATS)


class Model:
    """Standardised statistics -> cosines -> ridge score -> calibrated probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: float, features: int = FEATURES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(N_STATS, features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta: np.ndarray | None = None
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([phi, z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None or self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def summed(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations, one partial sum from each partition."""
    d = FEATURES + N_STATS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                f = model.features(matrix(part.column("x")))
                a += f.T @ f
                b += f.T @ np.asarray(part.column("y"), np.float64)
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()]})

    a, b = np.zeros((d, d)), np.zeros(d)
    for row in train.coalesce(PARTS).mapInArrow(run, "a binary, b binary").toLocalIterator():
        a += np.frombuffer(row.a).reshape(d, d)
        b += np.frombuffer(row.b)
    return a, b


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing step function through weighted means, as knots."""
    blocks: list[list[float]] = []
    for xi, yi, wi in sorted(zip(x, y, w, strict=True)):
        blocks.append([yi * wi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def binned(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean score, mean label and count of each of at most BINS bins of the raw score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.raw(matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.floor(np.clip(s, -1, 2) * BINS / 3).astype(np.int64)), "s": pa.array(s), "y": batch.column("y").cast(pa.float64())})

    got = rows.mapInArrow(run, "bin long, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).toArrow()
    return tuple(np.asarray(got.column(k), np.float64) for k in ("s", "y", "n"))


def fit(stats: DataFrame, labels: DataFrame, trainable: Column, label: str = "quality", most_rows: int = MOST_ROWS, ws: Workspace | None = None) -> Model:
    """A model from measured documents and labels; trainable is a condition on doc_id."""
    ws = ws or Workspace(stats.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & trainable)
    share = min(1.0, most_rows / max(1, known.count()))
    h = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000))
    known = known.filter(h < int(share * 1_000_000))
    train = ws.save(stats.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(4))), "train")
    one = train.select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    if one["m0"] is None:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), 1.0)
    mean = np.array([one[f"m{i}"] for i in range(N_STATS)])
    scale = np.maximum(np.array([one[f"s{i}"] for i in range(N_STATS)]), 1e-3)
    near = train.orderBy(F.xxhash64("doc_id", F.lit(SEED + 2))).select("x").limit(256).toArrow()
    z = np.clip((matrix(near.column(0).combine_chunks()) - mean) / scale, -8, 8)
    gaps = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))[np.triu_indices(len(z), 1)]
    model = Model(mean, scale, float(np.median(gaps)) if len(gaps) and np.median(gaps) > 0 else 1.0)
    a, b = summed(train.filter("fold > 0"), model)
    n = max(1.0, a[-1, -1])
    model.beta = np.linalg.solve(a + RIDGE * n * np.eye(len(a)), b)
    s, y, w = binned(train.filter("fold = 0"), model)
    if len(s):
        model.knots = isotonic(s, y, w)
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    ws.drop(train)
    return model


def score(stats: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, score, predicted of every measured document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([np.zeros(0), *(model.score(matrix(batch.slice(s, 4096).column("x"))) for s in range(0, batch.num_rows, 4096))])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ws = Workspace(docs.sparkSession)
    stats = ws.save(measure(docs), "stats")
    model = fit(stats, labels, F.coalesce(~held_out(), F.lit(False)), ws=ws)
    return score(stats, model, threshold).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
