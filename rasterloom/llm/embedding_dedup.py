"""Embedding near-dedup (2): sorted projection passes, verified pairs, and exact counts inside what they join.

In each pass a vector's signs against 63 random directions are one number; vectors are ordered by it, so neighbours
share a long run of signs, and each is compared with the next `window` in the order. Pairs whose longer sketches
(another 256 signs) differ no more than six standard deviations beyond what the threshold allows are verified by cosine
in double precision. The number of passes follows from the threshold, the window and the number of vectors, for a chance
of at most `miss` that a pair right at the threshold never shares the first signs of its numbers, as many as leave half
a window of evenly spread vectors alike. Where vectors are not evenly spread more are alike than a window holds: such a
run is compared whole, block by block. A pair that shares the signs is thus always compared, however dense the region,
and `miss` holds for any data. Verified pairs of all passes are joined.

Members of a group are then compared with each other, block by block, with all their links counted: the counts are
whole whatever the window. Vectors equal to the bit are one row
with a weight, so copies cost nothing. Neighbours that a partition's edge parts are compared in a second step.

Vectors that take no part (see vectors.usable) link with nothing: n_links 0, their own component, kept. A null id gets a
row with null component. Repeated rows of an id each come back; other rows than its own count as links. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace
from rasterloom.llm.graph import components, forest
from rasterloom.llm.vectors import matrix, units, usable

BITS, SKETCH, WINDOW, MISS, BLOCK, SEED = 63, 256, 32, 1e-3, 2048, 5
ENTRY = "pass int, code long, id long, sketch binary"


def shared(n: int, window: int = WINDOW) -> float:
    """First signs that half a window of n evenly spread vectors have alike."""
    return max(0.0, math.log2(max(2, n) / window) + 1)


def passes(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with a chance of at most `miss`."""
    agree = 1 - math.acos(threshold) / math.pi
    near = agree ** shared(n, window)
    return max(2, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - near)))) if near < 1 else 2


def tolerance(threshold: float) -> int:
    """Most differing signs of two sketches at the threshold, but for six standard deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def near_pairs(ids: np.ndarray, sketches: np.ndarray, group: np.ndarray, window: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `window` apart, of one pass, with close sketches."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(window, len(ids) - 1) + 1):
        apart = np.bitwise_count(sketches[:-step] ^ sketches[step:]).sum(1)
        hit = np.flatnonzero((apart <= most) & (group[:-step] == group[step:]))
        a.append(np.minimum(ids[hit], ids[hit + step]))
        b.append(np.maximum(ids[hit], ids[hit + step]))
    return np.concatenate(a), np.concatenate(b)


def projected(rows: DataFrame, n_passes: int, seed: int = SEED) -> DataFrame:
    """pass, code, id, sketch of each vector in each pass."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(matrix(batch.column("v")))
            d = x.shape[1]
            signs = lambda s, k: x @ np.random.default_rng([seed, s]).normal(size=(d, k)) >= 0
            sketch = [s.tobytes() for s in np.packbits(signs(0, SKETCH), axis=1)]
            weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
            for p in range(n_passes):
                code = signs(p + 1, BITS) @ weights
                yield pa.RecordBatch.from_pydict({"pass": pa.array(np.full(len(x), p, np.int32)), "code": pa.array(code), "id": batch.column("id"), "sketch": pa.array(sketch, pa.binary())})

    return rows.select("id", "v").mapInArrow(run, ENTRY)


def candidates(entries: DataFrame, parts: int, window: int, most: int, ws: Workspace) -> DataFrame:
    """a, b of close pairs within a window of any pass."""

    def arrays(table):
        sketch = np.stack([np.frombuffer(s, np.uint64) for s in table.column("sketch").to_pylist()]) if table.num_rows else np.zeros((0, SKETCH // 64), np.uint64)
        return table.column("id").to_numpy(), sketch, table.column("pass").to_numpy()

    def edge(rows: pa.Table, place: int, size: int, side: int) -> pa.RecordBatch:
        n = rows.num_rows
        cols = {"a": rows.column("id").combine_chunks(), "b": rows.column("id").combine_chunks()} | {c: rows.column(c).combine_chunks() for c in ("pass", "code", "sketch")}
        return pa.RecordBatch.from_pydict(cols | {"place": pa.array(np.full(n, place, np.int32)), "size": pa.array(np.full(n, size, np.int64)), "side": pa.array(np.full(n, side, np.int32))})

    def within(batches):
        held, head, size = None, None, 0  # the last rows of the batch before, the partition's first rows, all its rows
        for batch in batches:
            now = pa.Table.from_batches([batch])
            size += now.num_rows
            head = now.slice(0, window) if head is None else pa.concat_tables([head, now]).slice(0, window)
            table = pa.concat_tables([held, now]) if held is not None else now
            a, b = near_pairs(*arrays(table), window, most)
            none = {"pass": np.full(len(a), -1, np.int32), "code": np.zeros(len(a), np.int64), "place": np.full(len(a), -1, np.int32), "size": np.zeros(len(a), np.int64), "side": np.zeros(len(a), np.int32)}
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "pass": pa.array(none["pass"]), "code": pa.array(none["code"]), "sketch": pa.nulls(len(a), pa.binary()), **{c: pa.array(none[c]) for c in ("place", "size", "side")}})
            held = table.slice(max(0, table.num_rows - window))
        if size:  # compared with the neighbouring partitions' edges: place is the boundary
            me = TaskContext.get().partitionId()
            yield edge(head, me, size, 0)
            yield edge(held, me + 1, size, 1)

    def over(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pass", "ascending"), ("code", "ascending"), ("id", "ascending")])
        a, b = near_pairs(*arrays(table), window, most)
        return pa.table({"a": a, "b": b})

    ranged = entries.repartitionByRange(parts, "pass", "code", "id").sortWithinPartitions("pass", "code", "id")
    found = ws.save(ranged.mapInArrow(within, "a long, b long, pass int, code long, sketch binary, place int, size long, side int"), "windows")
    inner = found.filter(F.col("pass") < 0).select("a", "b")
    edges = found.filter(F.col("pass") >= 0).select(F.col("a").alias("id"), "pass", "code", "sketch", "place", "size", "side")
    heads = edges.filter("side = 0").agg(F.countDistinct("place").alias("n"), F.max("place").alias("last"), F.min("size").alias("least")).first()
    # a window reaches over one boundary at most where every partition holds one; with few rows edges meet by pass
    apart = heads.n > 0 and heads.n == heads.last + 1 and heads.least >= window
    edges = edges.dropDuplicates(["place", "pass", "id"] if apart else ["pass", "id"])
    outer = edges.select("id", "pass", "code", "sketch", "place").groupBy("place" if apart else "pass").applyInArrow(over, "a long, b long")
    return inner.union(outer).filter("a <> b").distinct()


def verified(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """u, v of the pairs whose cosine reaches the threshold."""
    from rasterloom.llm.vectors import cosine

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = pa.array(cosine(matrix(batch.column("x")), matrix(batch.column("y"))) >= threshold)
            yield pa.RecordBatch.from_pydict({"u": batch.column("a").filter(keep), "v": batch.column("b").filter(keep)})

    one = rows.select(F.col("id").alias("a"), F.col("v").alias("x"))
    two = rows.select(F.col("id").alias("b"), F.col("v").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


def in_runs(rows: DataFrame, n: int, n_passes: int, window: int, threshold: float, ws: Workspace, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """u, v that hold together what links do in runs of equal first signs that are longer than a window."""
    bits = min(BITS, int(shared(n, window)))

    def prefixes(batches):
        for batch in batches:
            x = units(matrix(batch.column("v")))
            weights = np.int64(1) << np.arange(bits, dtype=np.int64)
            for p in range(n_passes if len(x) else 0):
                # the first signs of the pass's code
                code = (x @ np.random.default_rng([seed, p + 1]).normal(size=(x.shape[1], BITS))[:, :bits] >= 0) @ weights
                yield pa.RecordBatch.from_pydict({"pass": pa.array(np.full(len(x), p, np.int32)), "run": pa.array(code.astype(np.int64)), "id": batch.column("id")})

    entries = ws.save(rows.select("id", "v").mapInArrow(prefixes, "pass int, run long, id long"), "prefixes")
    long = ws.save(entries.groupBy("pass", "run").agg(F.count("*").alias("size")).filter(F.col("size") > window + 1), "runs")
    members = entries.join(long, ["pass", "run"]).join(rows.select("id", "v"), "id")

    def run(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
        one, two = (np.flatnonzero(table.column(c).to_numpy()) for c in ("first", "second"))
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for mine, link in linked(ids, x, one, two, threshold):
            r, c = np.nonzero(link)
            held.append(forest(ids[mine[r]], ids[two[c]]))
        u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
        return pa.table({"u": u, "v": v})

    return in_blocks(members, block).groupBy("pass", "run", "i", "j").applyInArrow(run, "u long, v long")


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Members of groups (id, v, size, others), once for each pair i <= j of blocks that theirs is in."""
    m = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    m = m.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return m.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"), (F.col("block") >= F.col("other")).alias("second")).drop("blocks", "block", "other", "size")


def linked(ids: np.ndarray, x: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float):
    """Parts of the rows `one`, and which of the rows `two` each links with."""
    from rasterloom.llm.vectors import cosine

    u = units(x)
    for s in range(0, len(one), 512):
        mine = one[s : s + 512]
        dot = u[mine] @ u[two].T
        link = dot >= threshold
        # right at the threshold the order of additions decides: as in the verification
        for r, c in zip(*np.nonzero(np.abs(dot - threshold) < 1e-12), strict=True):
            link[r, c] = cosine(x[mine[r : r + 1]], x[two[c : c + 1]])[0] >= threshold
        yield mine, link & (ids[mine][:, None] != ids[two][None])


def counted(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """id, links of the members (id, v, weight, component, size) of components: weights of linked others."""

    def run(table: pa.Table) -> pa.Table:
        ids, weight, x = table.column("id").to_numpy(), table.column("weight").to_numpy(), matrix(table.column("v"))
        one, two = (np.flatnonzero(table.column(c).to_numpy()) for c in ("first", "second"))
        links = np.zeros(len(ids), np.int64)
        for mine, link in linked(ids, x, one, two, threshold):
            links[mine] += link @ weight[two]
            if len(one) != len(two) or not np.array_equal(one, two):
                links[two] += link.T @ weight[mine]
        return pa.table({"id": ids, "links": links})

    m = in_blocks(members.select("id", "v", "weight", "component", "size"), block)
    return m.groupBy("component", "i", "j").applyInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def dedup(table: DataFrame, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding", window: int = WINDOW) -> DataFrame:
    """<key>, n_links, component_id, kept of every row."""
    ws = Workspace(table.sparkSession)
    rows = ws.save(usable(table, key, column), "rows")
    points = ws.save(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "points")
    n = points.count()
    k = passes(n, threshold, window)
    parts = max(12, -(-n * k // 100_000))
    pairs = candidates(projected(points, k), parts, window, tolerance(threshold), ws)
    links = verified(ws.save(pairs, "pairs"), points, threshold).union(in_runs(points, n, k, window, threshold, ws))
    found = components(links, ws)
    joined = points.join(found.withColumnRenamed("node", "id"), "id")
    sizes = ws.save(joined.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    links = counted(ws.save(joined, "members").join(sizes, "component"), threshold)
    full = points.join(found.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
    full = full.select("v", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # rows of a vector learn its class through the smallest id's; a hot vector's rows are split by the join
    by_row = rows.join(ws.save(full, "full"), "v").select(F.col("id").alias(key), "component", "n_links")
    rest = table.select(F.col(key).cast("long").alias(key))
    unused = rest.join(rows.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(key, F.col(key).alias("component"), F.lit(0).cast("long").alias("n_links"))
    out = by_row.unionByName(unused)
    return out.select(key, "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col(key), F.lit(True)).alias("kept"))
