"""N-gram Jaccard join (6): a count-vector R-tree, with every surviving pair verified.

A document is the set of its distinct word shingles, as 64-bit hashes. Documents of equal sets are one point, that of
their smallest id. Shingles are hashed into groups; the counts by group make the point of a set. The overlap of two
sets is at most the sum over groups of the smaller count, and of a set with anything in a box at most the sum of the
smaller of its count and the box's upper corner: a tree of boxes over points gives up whole branches by that bound.

The upper levels of the tree are groups of one shingle each, in one global order, rare groups first. By the same bound
two sets that overlap enough must share one of the first n - least + 1 shingles of each, so a point enters the nodes of
these only. In each node all points are first verified against the node's smallest id; the links join points into
components. Nodes that then hold points of several components get a box tree over their points, and pairs of different
components that survive its bound are verified. Pairs within a component need no look: they are joined. So no link
between components is missed, and none is made that was not verified. This part of the work, an index from rare
single-shingle groups, is what makes the join near linear; boxes of many coordinates alone would not part a large table.

Nodes with many points of several components are cut into blocks. No two points of different components are both of a
node's largest component, so only the others are crossed with all, each pair of blocks in a task of its own.

Null and empty texts, and texts without words, have empty sets and link with nothing. With fewer words than the shingle
length, the whole sequence is the one shingle. Repeated rows of an id each come back; they count as one document. A
row with a null id links with nothing. An empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace, as_bytes, freed, partitions, slices
from rasterloom.llm.graph import components

#: Hash groups whose counts give the order of shingles, and coordinates of a point.
ORDER_GROUPS, DIMS, ORDER_PARTS = 1 << 18, 256, 64
LEAF, BLOCK, MOST = 16, 512, 65_535
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
    h = names[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(coded) else np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        rolled = np.full(len(h), width, np.uint64)
        n = len(h)
        for j in range(width):
            if n > j:
                rolled[: n - j] = mixed(rolled[: n - j] * MIX + h[j:])
        out = []
        for e, k, w in zip(ends, sizes, words, strict=True):
            if k >= width:
                out.append(np.unique(rolled[e - k : e - width + 1]))
            elif k:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=int(k))], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def group_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents hold a shingle of each order group: summed by parts of the groups, not by documents."""
    step = ORDER_GROUPS // ORDER_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_GROUPS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                held = np.concatenate(shingles(as_bytes(part.column("text")), width))
                total += np.bincount((held >> np.uint64(46)).astype(np.int64), minlength=ORDER_GROUPS)
        yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(ORDER_PARTS)), "n": pa.array([total[i * step : (i + 1) * step].astype(np.int32).tobytes() for i in range(ORDER_PARTS)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(n, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int64()), "n": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = docs.select("text").mapInArrow(run, "part long, n binary")
    # two rounds: parts of the sums meet by part, each a fixed few kilobytes
    got = parts.repartition(ORDER_PARTS, "part").mapInArrow(add, "part long, n binary").toArrow()
    total = np.zeros(ORDER_GROUPS, np.int64)
    for p, n in zip(got.column("part").to_pylist(), got.column("n").to_pylist(), strict=True):
        total[p * step : (p + 1) * step] += np.frombuffer(n, np.int64)
    return total


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Least intersection of sets of n and m elements that link: 100 i >= percent (n + m - i)."""
    return -(-percent * (np.asarray(n, np.int64) + m) // (100 + percent))


def points(docs: DataFrame, width: int, percent: int, order: np.ndarray) -> DataFrame:
    """doc_id, n, fp (hash of the set), prefix (shingles of the nodes it enters), vec (counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # one number for each of the fixed groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(as_bytes(part.column("text")), width)
                n, fp, prefix, vec = [], [], [], []
                for s in sets:
                    n.append(len(s))
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    need = -(-percent * len(s) // 100)  # the overlap with a partner is at least this
                    k = len(s) - need + 1 if len(s) else 0
                    by = rank[(s >> np.uint64(46)).astype(np.int64)]
                    prefix.append(s[np.lexsort((s, by))[:k]].tobytes())
                    held = np.bincount((s & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
                    # a count beyond 16 bits leaves the whole bound open rather than too low
                    vec.append((held if held.max() < MOST else np.full(DIMS, MOST)).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.binary()), "prefix": pa.array(prefix, pa.binary()), "vec": pa.array(vec, pa.binary())}
                )

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, prefix binary, vec binary")


def entries(points_: DataFrame) -> DataFrame:
    """shingle, id of every node that a point enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
            sizes = [len(h) for h in held]
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate([np.zeros(0, np.int64), *held])), "id": pa.array(np.repeat(ids, sizes))})

    return points_.select("id", "prefix").mapInArrow(run, "node long, id long")


def bounded(pairs: DataFrame, points_: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose counts leave room for enough overlap."""
    left = points_.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = points_.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = counts(batch.column("va")), counts(batch.column("vb"))
            need = least_overlap(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            keep = pa.array(np.minimum(va, vb).sum(1) >= need)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)})

    near = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a long, b long")


def counts(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, DIMS).astype(np.int32)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, ws: Workspace) -> DataFrame:
    """u, v of the pairs (a, b) whose sets link. Sets are made anew from the texts of the documents in pairs alone."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(as_bytes(part.column("text")), width)
                yield pa.RecordBatch.from_pydict({"id": part.column("doc_id"), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                ok.append(100 * both >= percent * (len(one) + len(two) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_pydict({"u": batch.column("a").filter(keep), "v": batch.column("b").filter(keep)})

    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(shingled, "id long, set binary")
    sets = ws.save(sets, "sets")
    freed(ws)
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    links = ws.save(full.select("a", "b", "x", "y").mapInArrow(run, "u long, v long"), "links")
    freed(ws, sets)
    return links


class Boxes:
    """A packed R-tree over count vectors: leaves of LEAF points in sorted order, boxes above by their upper corners."""

    def __init__(self, vecs: np.ndarray, sizes: np.ndarray) -> None:
        # sort-tile order: by size, then by the heaviest coordinate, so that neighbours share a box
        self.order = np.lexsort((vecs.argmax(1), sizes))
        self.vecs, self.sizes = vecs[self.order], sizes[self.order]
        self.levels = [(self.vecs, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > LEAF:
            v, lo, hi = self.levels[-1]
            cut = np.arange(0, len(v), LEAF)
            self.levels.append((np.maximum.reduceat(v, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def near(self, vec: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose bound lets them link with a set of this vector and size."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            v, lo, hi = self.levels[k]
            fits = (100 * hi[at] >= percent * size) & (100 * size >= percent * lo[at])
            at = at[fits]
            at = at[np.minimum(v[at], vec).sum(1) >= least_overlap(size, lo[at], percent)]
            if k:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


def leaves(node: np.ndarray, comp: np.ndarray, sizes: np.ndarray, vecs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs within small nodes, in order of node, of different components, that survive the bound."""
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, LEAF):
        at = np.flatnonzero((node[step:] == node[:-step]) & (comp[step:] != comp[:-step]))
        x, y = sizes[at], sizes[at + step]
        at = at[(100 * x >= percent * y) & (100 * y >= percent * x)]
        for s in range(0, len(at), 50_000):
            part = at[s : s + 50_000]
            part = part[np.minimum(vecs[part], vecs[part + step]).sum(1) >= least_overlap(sizes[part], sizes[part + step], percent)]
            one.append(part)
            two.append(part + step)
    return np.concatenate(one), np.concatenate(two)


def crossing(points_: DataFrame, entered: DataFrame, found: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """a, b of pairs in one node but of different components that survive the bound."""
    labelled = entered.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("node", "id", F.coalesce("component", "id").alias("component"))
    labelled = ws.save(labelled, "labelled")
    mixed_ = labelled.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("members"), F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40))).alias("also")).filter("lo < hi")
    # nodes of the same points, as those of one shared passage, are searched once
    mixed_ = ws.save(mixed_.groupBy("lo", "hi", "n", "members", "also").agg(F.min("node").alias("node")).select("node", "n"), "mixed")
    members = ws.save(labelled.join(mixed_, "node"), "members")
    # two points of different components are never both of a node's largest one: only the others are crossed with all
    by = members.filter(F.col("n") > LEAF).groupBy("node", "component").agg(F.count("*").alias("k"))
    largest = by.groupBy("node").agg(F.max(F.struct("k", "component")).alias("t")).select("node", F.col("t.component").alias("top"), F.col("t.k").alias("k"))
    members = members.join(ws.save(largest, "largest"), "node", "left")
    members = members.withColumn("few", F.col("component") != F.col("top"))
    # a member is in one of the blocks of all; those not of the largest component are in one of their own blocks too
    alls, fews = F.ceil(F.col("n") / BLOCK).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("k")) / BLOCK).cast("int"))
    members = members.withColumn("alls", alls).withColumn("fews", fews)
    mine = lambda of: F.pmod(F.xxhash64("id"), F.col(of).cast("long")).cast("int")
    small, parts = F.col("n") <= LEAF, partitions(mixed_.agg(F.sum("n")).first()[0] or 0, 50_000)
    rows = [members.filter(small).select("node", "id", "component", F.lit(True).alias("small"), F.pmod("node", F.lit(parts)).alias("place"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(True).alias("first"))]
    large = members.filter(~small)
    place = ["node", "id", "component", F.lit(False).alias("small"), F.col("node").alias("place")]
    rows.append(large.filter("few").select(*place, mine("fews").alias("i"), F.explode(F.expr("sequence(0, alls - 1)")).alias("j"), F.lit(True).alias("first")))
    rows.append(large.select(*place, F.explode(F.expr("sequence(0, fews - 1)")).alias("i"), mine("alls").alias("j"), F.lit(False).alias("first")))
    members = rows[0].unionByName(rows[1]).unionByName(rows[2])
    members = members.join(points_.select("id", "vec", F.col("n").alias("size")), "id")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("id", "ascending")])
        ids, comp, sizes, node = (table.column(c).to_numpy() for c in ("id", "component", "size", "node"))
        vecs = counts(table.column("vec"))
        if table.column("small")[0].as_py():
            x, y = leaves(node, comp, sizes, vecs, percent)
            pair = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]), axis=1)
            return pa.table({"a": pair[0], "b": pair[1]})
        first = table.column("first").to_numpy()
        one, two = np.flatnonzero(first), np.flatnonzero(~first)
        if not len(one) or not len(two):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        tree = Boxes(vecs[two], sizes[two])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in one:
            hit = two[tree.near(vecs[i], int(sizes[i]), percent)]
            hit = hit[(comp[hit] != comp[i]) & (ids[hit] != ids[i])]
            a.append(np.minimum(ids[hit], ids[i]))
            b.append(np.maximum(ids[hit], ids[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return members.groupBy("place", "i", "j").applyInArrow(search, "a long, b long").distinct()


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; a document without shingles, or a null id, is its own."""
    ws = Workspace(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = group_counts(rows, width)
    every = ws.save(points(rows, width, percent, order), "points")
    full = every.filter("n > 0 and doc_id is not null")
    same = ws.save(full.groupBy("fp").agg(F.min("doc_id").alias("id")), "same")
    # one point for each set; rows that repeat an id with other text are points of that id each, and texts below
    kept = full.withColumnRenamed("doc_id", "id").join(same, ["id", "fp"], "left_semi").select("id", "n", "prefix", "vec")
    kept = ws.save(kept.dropDuplicates(["id"]) if every.count() != every.select("doc_id").distinct().count() else kept, "kept")
    slim = ws.save(every.select("doc_id", "n", "fp"), "slim")
    freed(ws, every)
    entered = entries(kept)
    # several centres for each node, so that a point that is far from one still meets its group
    centres = F.array_distinct(F.array(F.min("id"), F.max("id"), F.min(F.struct(F.xxhash64("id"), "id"))["id"])).alias("stars")
    nodes = ws.save(entered.groupBy("node").agg(centres, F.count("*").alias("n")).filter("n > 1").select("node", "stars"), "nodes")
    # only nodes with several points matter from here on
    shared = ws.save(entered.join(nodes, "node"), "shared")
    spokes = shared.select("id", F.explode("stars").alias("star")).filter("id <> star").select(F.least("id", "star").alias("a"), F.greatest("id", "star").alias("b"))
    spokes = ws.save(spokes.distinct(), "spokes")
    texts = rows.filter("doc_id is not null")
    stars = verified(ws.save(bounded(spokes, kept, percent), "near"), texts, width, percent, ws)
    found = components(stars, ws)
    loose = ws.save(crossing(kept, shared.select("node", "id"), found, ws, percent), "loose")
    freed(ws, spokes, nodes)
    if loose.limit(1).count():
        more = verified(loose, texts, width, percent, ws)
        found = components(stars.union(more), ws) if more.limit(1).count() else found
    ids = same.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    ids = ws.save(ids, "ids")
    out = slim.select("doc_id", "n", "fp", F.expr("n > 0 and doc_id is not null").alias("real"))
    return out.join(ids, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("real"), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
