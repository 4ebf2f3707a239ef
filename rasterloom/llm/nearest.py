"""Approximate nearest neighbours (1): anisotropic product quantisation, four-bit table scans, exact reranking.

Codebooks of 16 centres for each pair of dimensions are fitted on a bounded sample. Assignment and update both use the
score-aware loss: for unit vectors the part of the residual parallel to the vector weighs eta times the orthogonal
part, eta = (d - 1) T^2 / (1 - T^2), since errors along a vector move its large inner products most. Assignments are
improved coordinate by coordinate, centres by the normal equations of the loss. Every vector is encoded; two four-bit
codes share a byte, and a query looks up both at once in tables of 256 sums. Each block of codes is scanned for each
block of queries. The best `depth` of a block are reranked by the cosine of the original vectors; the k + 1 th best of
these is a bar, and a row's cosine exceeds its score by the length of its residual at most. All rows that can so reach
the bar are reranked too, be they `depth` or the whole block. The best k + 1 of each block go on, so nothing is missed.

Vectors equal to the bit are one row with their k + 1 smallest ids: no more of them can be among k nearest, with ties
to smaller ids and a query's own row left out. That loses nothing and keeps copies from filling a candidate list.

The queries are a stated set; they meet all rows block by block, both sides dealt by block number. Vectors that take
no part (see vectors.usable) are neither queries nor candidates. With fewer candidates than k all are returned. Repeated
ids are one row each in the index, and a query row each only once. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace
from rasterloom.llm.vectors import cosine, matrix, units, usable

SAMPLE, CENTRES, PAIR, THRESHOLD, SEED = 8192, 16, 2, 0.2, 11
ROW_BLOCK, QUERY_BLOCK, DEPTH = 8192, 8192, 100
#: More than the single precision of scores can be off.
SLACK = 1e-4


class Quantiser:
    """Codebooks c[subspace, centre, dimension] and the loss they were fitted to."""

    def __init__(self, x: np.ndarray, rounds: int = 8, seed: int = SEED) -> None:
        self.d = x.shape[1]
        self.spaces = -(-self.d // (2 * PAIR)) * 2
        self.eta = max(1.0, (self.d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = self.split(x)
        rng = np.random.default_rng(seed)
        self.c = np.stack([x[rng.integers(0, len(x), CENTRES), s] for s in range(self.spaces)])
        self.c += rng.normal(scale=1e-4, size=self.c.shape)
        for _ in range(rounds):
            code = self.assign(x, 2)
            self.update(x, code)

    def split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.spaces * PAIR))
        wide[:, : self.d] = x
        return wide.reshape(len(x), self.spaces, PAIR)

    def assign(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes of split unit vectors, by coordinate descent on the loss."""
        gap = ((x[:, :, None] - self.c[None]) ** 2).sum(-1)  # rows, subspaces, centres
        along = (x * x).sum(-1)[:, :, None] - np.einsum("nsp,skp->nsk", x, self.c)
        code = gap.argmin(-1)
        rows = np.arange(len(x))
        parallel = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for s in range(self.spaces):
                rest = parallel - along[rows, s, code[:, s]]
                best = (gap[:, s] + (self.eta - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(-1)
                code[:, s] = best
                parallel = rest + along[rows, s, best]
        return code

    def update(self, x: np.ndarray, code: np.ndarray) -> None:
        """Centres that minimise the loss for given codes; unused centres stay."""
        n, size = len(x), self.spaces * CENTRES * PAIR
        cell = (np.arange(self.spaces) * CENTRES + code) * PAIR  # first unknown of each row and subspace
        at = (cell[:, :, None] + np.arange(PAIR)).reshape(n, -1)
        flat = x.reshape(n, -1)
        b = np.bincount(at.ravel(), flat.ravel(), size)
        uses = np.bincount(at.ravel(), minlength=size)
        a = np.zeros((size, size))
        for s in range(0, n, 2048):
            v = np.zeros((len(at[s : s + 2048]), size))
            np.put_along_axis(v, at[s : s + 2048], flat[s : s + 2048], 1)
            a += v.T @ v
        a = (self.eta - 1) * a + np.diag(uses + 1e-6)
        got = np.linalg.solve(a, self.eta * b)
        self.c = np.where((uses > 0).reshape(self.c.shape), got.reshape(self.c.shape), self.c)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two four-bit codes in each byte, and the lengths of the residuals."""
        codes, gaps = [np.zeros((0, self.spaces), np.int64)], [np.zeros(0)]
        for s in range(0, len(x), 4096):
            part = self.split(x[s : s + 4096])
            codes.append(self.assign(part))
            gaps.append(np.sqrt(((part - self.c[np.arange(self.spaces), codes[-1]]) ** 2).sum((1, 2))))
        code = np.concatenate(codes).astype(np.uint8)
        return code[:, 0::2] | code[:, 1::2] << 4, np.concatenate(gaps)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte, the sum of both inner products for each of the 256 values."""
        t = np.einsum("nsp,skp->nsk", self.split(q), self.c)
        return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(q), self.spaces // 2, 256).astype(np.float32)


def scanned(index: pa.Table, queries: pa.Table, quantiser: Quantiser, depth: int, most: int) -> pa.Table:
    """The `most` nearest rows of a block for each query of a block, and their cosines; ties to smaller ids."""
    code = np.stack([np.frombuffer(c, np.uint8) for c in index.column("code").to_pylist()]).T.copy()
    ids, gap, x = index.column("id").to_numpy(), index.column("gap").to_numpy(), matrix(index.column("v"))
    v = matrix(queries.column("v"))
    q, u, name = units(v), units(x), queries.column("query_id").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), 64):
        for row, table in enumerate(quantiser.tables(q[s : s + 64]), s):
            score = np.zeros(len(ids), np.float32)
            for byte, of in zip(code, table, strict=True):
                score += of[byte]
            near = np.arange(len(ids))
            if len(ids) > max(depth, most):
                top = np.argpartition(-score, depth - 1)[:depth]
                bar = np.partition(u[top] @ q[row], -min(most, depth))[-min(most, depth)] if depth >= most else -2.0
                near = np.flatnonzero(score + gap >= bar - SLACK)
            dot = u[near] @ q[row]
            if len(near) > most:
                near = near[dot >= np.partition(dot, -most)[-most] - 1e-9]
            exact = cosine(v[row : row + 1], x[near])
            best = np.lexsort((ids[near], -exact))[:most]
            out.append((np.full(len(best), name[row]), ids[near][best], exact[best]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "near": pa.array(cols[2], pa.float64())})


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """id (the smallest), v, ids (at most `most`, smallest first) of each distinct vector."""
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    by = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return by.select(F.col("ids")[0].alias("id"), "v", "ids")


def search(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", depth: int = DEPTH) -> DataFrame:
    """query_id, rank, <key>, score: the k nearest by cosine of each row for which is_query (a condition on id) holds."""
    spark = table.sparkSession
    ws = Workspace(spark)
    rows = ws.save(usable(table, key, column).dropDuplicates(["id"]), "rows")
    index = ws.save(distinct_vectors(rows, k + 1), "distinct")
    queries = ws.save(rows.filter(is_query).select(F.col("id").alias("query_id"), "v"), "queries")
    n, m = index.count(), queries.count()
    schema = f"query_id long, rank int, {key} long, score double"
    if not n or not m:
        return spark.createDataFrame([], schema)
    sample = index.orderBy(F.xxhash64("id", F.lit(SEED))).limit(SAMPLE).select("v").toArrow()
    quantiser = Quantiser(units(matrix(sample.column("v"))))
    shared = spark.sparkContext.broadcast(quantiser)  # 16 centres for each pair of dimensions
    row_blocks, query_blocks = max(12, -(-n // ROW_BLOCK)), -(-m // QUERY_BLOCK)

    def encode(batches):
        for batch in batches:
            code, gap = shared.value.encode(units(matrix(batch.column("v"))))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "code": pa.array([c.tobytes() for c in code], pa.binary()), "gap": pa.array(gap, pa.float64())})

    coded = index.select("id", "v").mapInArrow(encode, "id long, v array<double>, code binary, gap double")
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    left = coded.withColumn("rb", block("id", row_blocks)).withColumn("qb", every)
    right = queries.withColumn("qb", block("query_id", query_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def scan(index_: pa.Table, queries_: pa.Table) -> pa.Table:
        if not index_.num_rows or not queries_.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        return scanned(index_, queries_, shared.value, depth, k + 1)

    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(scan, "query_id long, id long, near double")
    # a vector's rows come after no more than one row of each vector before it
    best = near.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))).filter(F.col("k") <= k + 1)
    scored = ws.save(best.select("query_id", "id", F.col("near").alias("score")), "best").join(index.select("id", "ids"), "id")
    each = scored.select("query_id", F.explode("ids").alias(key), "score").filter(F.col(key) != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
