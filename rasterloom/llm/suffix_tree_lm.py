"""LM scoring (5): a probabilistic suffix tree over the bytes of normalised text, beside an add-one unigram base.

A text is lower-cased (A-Z), cut into words at white space and joined by single spaces; a line feed marks its end and
tabs stand before its start, neither of which a word can hold. All grams of LONGEST + 1 bytes are counted: their number
and that of the contexts follow the corpus, and no share or number of states bounds them. A context of more than LOW
bytes is retained if it occurs LEAST times or more in the training texts and a divergence test tells its next-byte
distribution from its suffix's; contexts of up to LOW bytes all are. A retained context's distribution is smoothed
towards that of its longest retained suffix, and the root's over all bytes. A byte is scored by the longest retained
suffix of what stands before it.

The tree is never in one place. Grams are ordered by their context read backwards, so that a branch of the tree is a
range of them, and are dealt to buckets by the quantiles of a sample, as a sort would: a frequent context is cut into
as many buckets as it needs. Contexts that a boundary cuts through, at most LONGEST - LOW for each boundary, are
counted on their own and handed to the buckets on either side. In a bucket the counts of all slices are added up,
contexts tested, and each gram's log probability (to 15 bits) goes back to the slices that have it. What is
broadcast is the boundaries, a few numbers for each bucket, and all contexts of up to LOW bytes, at most 256 ** LOW.

The unigram counts need each word's count over all training texts. Each slice of texts sends its distinct words, in
buckets by hash, to where they are added up; the totals come back to the slice. Words are compared as bytes, and no
vocabulary is broadcast. Slices are written once, normalised and compressed, and read again by each step.

Null texts are empty: one end token. Rows with a null id are trained on (no remainder holds them out). Repeated rows
count each time. Without training rows every count is 0 and the tree is its root. Extra columns are left aside.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace, as_bytes, freed, gathered, partitions

END, PAD = 10, 9
#: Bytes of the longest contexts, of those that are broadcast, and least occurrences of a longer one.
LONGEST, LOW, LEAST = 7, 2, 2
#: Bytes of text to a slice.
SLICE = 8 << 20
#: Least divergence, in nats over all of a context's positions, for each of its next bytes but one.
TEST = 2.0
PAYLOAD, SHORT, SAMPLE, WORDS, GRAMS, OPEN = range(6)
#: One of so many distinct grams of a slice is in the sample that places boundaries, and how many of it a bucket gets.
SPARSE, PER_BUCKET = 1 << 14, 64
#: Contexts that a boundary cuts, to a part of their counts.
PART = 256
#: Parts in which grams are answered and slices scored, one after the other: shuffles of one alone are on disk.
ROUNDS = 3
SCHEMA = "slice long, kind int, bucket int, first int, size int, a binary, b binary, c binary"
NAMES = ["slice", "kind", "bucket", "first", "size", "a", "b", "c"]


def normal(texts: list[bytes]) -> list[bytes]:
    """Words of each text, in lower case, with single spaces."""
    return [b" ".join(t.lower().split()) for t in texts]


def packed(x: np.ndarray) -> bytes:
    """Integers or floats, compressed one byte of each after the other."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(b: bytes | pa.Buffer, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def coarse(x: np.ndarray) -> np.ndarray:
    """Floats rounded to 15 significant bits, which pack into some two bytes."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(0x100)) & np.uint32(0xFFFFFE00)).view(np.float32)


def keys(texts: list[bytes], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each normalised text and its end: its context, last byte highest, and itself; the texts' sizes."""
    pad = bytes([PAD]) * LONGEST
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    buf = np.frombuffer(pad + (b"\n" + pad).join(texts) + b"\n", np.uint8)
    out, at = np.empty(int(sizes.sum()), np.uint64), 0
    for s in range(LONGEST, len(buf), step):
        e = min(len(buf), s + step)
        k = buf[s:e].astype(np.uint64)
        for j in range(1, LONGEST + 1):
            k |= buf[s - j : e - j].astype(np.uint64) << np.uint64(64 - 8 * j)
        k = k[buf[s:e] != PAD]
        out[at : at + len(k)] = k
        at += len(k)
    return out, sizes


def counted(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of k, which is sorted in place, and how often each is there."""
    k.sort()
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.diff(np.append(first, len(k)))


def narrowed(k: np.ndarray, d: int) -> np.ndarray:
    """Keys of the last d bytes of the context."""
    return ((k >> np.uint64(64 - 8 * d)) << np.uint64(8) if d else np.zeros_like(k)) | (k & np.uint64(255))


def short(k: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of keys of d bytes of context and of their contexts, for d up to LOW, from keys of LOW bytes."""
    out: dict[str, np.ndarray] = {}
    for d in range(LOW + 1):
        u, at = np.unique(k >> np.uint64(8 * (LOW - d + 1)) << np.uint64(8) | k & np.uint64(255), return_inverse=True)
        ks = np.bincount(at, n, len(u))
        c, of = np.unique(u >> np.uint64(8), return_inverse=True)
        total, after = np.bincount(of, ks, len(c)), np.bincount(of, minlength=len(c))
        out |= {f"key{d}": u, f"n{d}": ks, f"context{d}": c, f"total{d}": total, f"after{d}": after}
    return out


def looked(table: np.ndarray, values: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The value of each of k in a sorted table, 0 where it is not there."""
    if not len(table):
        return np.zeros(len(k))
    at = np.minimum(np.searchsorted(table, k), len(table) - 1)
    return np.where(table[at] == k, values[at], 0.0)


Cut = dict[tuple[int, int], np.ndarray]


def probabilities(u: np.ndarray, n: np.ndarray, low: dict[str, np.ndarray], cut: Cut) -> np.ndarray:
    """Probability of each gram: u (sorted) is a range of all grams and n their training counts.

    cut has the counts by next byte, over all grams, of the contexts (bytes, number) that an end of the range parts.
    """
    follows = (u & np.uint64(255)).astype(np.int64)
    p = np.full(len(u), 1 / 256)
    for d in range(LOW + 1):
        k = narrowed(u, d)
        ks = looked(low[f"key{d}"], low[f"n{d}"], k)
        total, after = (looked(low[f"context{d}"], low[f"{x}{d}"], k >> np.uint64(8)) for x in ("total", "after"))
        back = np.maximum(1, after) if d else 256  # one for each byte at the root
        p = (ks + back * p) / (total + back)
    every = np.arange(256, dtype=np.uint64)
    for d in range(LOW + 1, LONGEST + 1):
        c = u >> np.uint64(64 - 8 * d)
        head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(c))))  # contexts are runs
        if d < LONGEST:
            cells, first, at = np.unique(of * 256 + follows, return_index=True, return_inverse=True)
        else:
            cells, first, at = of * 256 + follows, np.arange(len(u)), np.arange(len(u))
        whose = cells >> 8
        k = np.bincount(at, n, len(cells))
        sums, after = np.bincount(of, n), np.bincount(whose, k > 0)
        ends = {}
        for j in {0, len(head) - 1}:
            held = cut.get((d, int(c[head[j]])))
            if held is not None:
                mine = whose == j
                k[mine], sums[j], after[j] = held[cells[mine] & 255], held.sum(), (held > 0).sum()
                ends[j] = held
        up_k, up_total = ks[first], total[first]  # of the suffix
        gain = np.zeros(len(cells))
        some = k > 0
        gain[some] = k[some] * np.log(k[some] / sums[whose[some]] * up_total[some] / up_k[some])
        gain = np.bincount(whose, gain)
        for j, held in ends.items():  # next bytes of the context that are in other buckets count as well
            suffix = int(c[head[j]]) >> 8
            over = cut[d - 1, suffix] if d - 1 > LOW else looked(low[f"key{LOW}"], low[f"n{LOW}"], np.uint64(suffix << 8) | every)
            some = held > 0
            gain[j] = (held[some] * np.log(held[some] / held.sum() * over.sum() / over[some])).sum()
        keep = (sums >= LEAST) & (gain > TEST * np.maximum(1, after - 1))
        ks, total, back = k[at], sums[of], np.maximum(1, after)[of]
        p = np.where(keep[of], (ks + back * p) / (total + back), p)
    return p


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:5]), *(pa.array(c, pa.binary()) for c in cols[5:])], NAMES)


def lots(texts: list[bytes], size: int = 1 << 20) -> list[slice]:
    """The texts in turn, some `size` bytes at a time."""
    ends, held = [0], 0
    for i, t in enumerate(texts, 1):
        held += len(t)
        if held >= size or i == len(texts):
            ends.append(i)
            held = 0
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def prepared(docs: DataFrame, sparse: int) -> DataFrame:
    """For each slice of texts a payload row, its short training grams, and its sample of grams.

    Payload: a ids, b null flags and training flags, c normalised text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", SLICE):
            texts = normal(as_bytes(part.column("text")))
            ids, train = part.column("doc_id"), np.asarray(part.column("train").to_numpy(zero_copy_only=False), bool)
            flags = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes() + train.astype(np.uint8).tobytes()
            name, whole = uuid.uuid4().int >> 66, b"\n".join(texts)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
            rows = [(name, PAYLOAD, 0, 0, len(whole), known, flags, pa.compress(whole, "zstd", asbytes=True))]
            del whole, part
            sample, few = [], []
            for lot in lots(texts):  # a part of the texts at a time: neither needs their order
                k, sizes = keys(texts[lot])
                chosen = (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                sample.append(k[chosen % np.uint64(sparse) == 0])
                few.append(counted(narrowed(k[np.repeat(train[lot], sizes)], LOW).astype(np.uint32)))
                del k, chosen
            sample = np.unique(np.concatenate(sample))
            rows.append((name, SAMPLE, 0, 0, len(sample), packed(sample), None, None))
            short_, of = np.unique(np.concatenate([x for x, _ in few]), return_inverse=True)
            rows.append((name, SHORT, 0, 0, len(short_), packed(short_), packed(np.bincount(of, np.concatenate([n for _, n in few]), len(short_)).astype(np.int32)), None))
            yield as_batch(rows)

    return docs.mapInArrow(run, SCHEMA)


def short_counts(kept: DataFrame) -> dict[str, np.ndarray]:
    """All contexts of up to LOW bytes: their number is bounded by that of the bytes, not by a choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, a, b in zip(batch.column("size").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"k": pa.array(unpacked(a, size, np.uint32).astype(np.int64)), "n": pa.array(unpacked(b, size, np.int32).astype(np.int64))})

    rows = kept.filter(F.col("kind") == SHORT).select("size", "a", "b").mapInArrow(run, "k long, n long")
    got = rows.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return short(got.column("k").to_numpy().astype(np.uint64), got.column("n").to_numpy().astype(float))


def boundaries(kept: DataFrame, per_bucket: int) -> np.ndarray:
    """First grams of all buckets but the first: quantiles of the sample, `per_bucket` of it to a bucket."""
    got = kept.filter(F.col("kind") == SAMPLE).select("size", "a").toArrow()
    sample = [unpacked(a, n, np.uint64) for n, a in zip(got.column("size").to_pylist(), got.column("a").to_pylist(), strict=True)]
    return np.unique(np.sort(np.concatenate([np.zeros(0, np.uint64), *sample]))[per_bucket::per_bucket])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word of the texts its text and its number, and the distinct words by number."""
    per = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    buf = np.frombuffer(b" ".join(t for t in texts if t) + b" " if per.any() else b"", np.uint8)
    ends = np.flatnonzero(buf == 32)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[buf != 32].tobytes())])
    coded = words.dictionary_encode()
    return np.repeat(np.arange(len(texts)), per), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def by_bucket(words: pa.Array, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, their order by bucket, and where each bucket begins in it."""
    names = words.to_pylist()
    bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in names], np.int64)
    order = np.argsort(bucket, kind="stable")
    return names, order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def opened(u: np.ndarray, n: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a slice's training grams by (number of a cut context) * 256 + next byte."""
    found, times, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for d, contexts in enumerate(cuts, LOW + 1):
        c = u >> np.uint64(64 - 8 * d)
        lo, hi = (np.searchsorted(c, contexts, side) for side in ("left", "right"))
        many = hi - lo
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        cell = np.repeat(base + np.arange(len(contexts)), many) * 256 + (u[at] & np.uint64(255)).astype(np.int64)
        cell, of = np.unique(cell, return_inverse=True)
        found.append(cell)
        times.append(np.bincount(of, n[at], len(cell)).astype(np.int64))
        base += len(contexts)
    return np.concatenate(found), np.concatenate(times)


def dealt(payload: DataFrame, buckets: int, edges: np.ndarray, cuts: list[np.ndarray]) -> DataFrame:
    """Each slice's words and grams by bucket, and its counts of the contexts that boundaries cut.

    Words: a their bytes, b lengths, c training counts; they have the numbers from `first` on. Grams: a the differences
    of keys, b training counts, numbered likewise. Cut contexts: a the differences of cells, b counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, texts = row["slice"], texts_of(row)
                train = np.frombuffer(row["b"], np.uint8)[len(texts) :].astype(bool)
                of, code, words = words_of(texts)
                times = np.bincount(code[train[of]], minlength=len(words)).astype(np.int32)
                names, order, at = by_bucket(words, buckets)
                rows = []
                for b in np.flatnonzero(np.diff(at)):
                    mine = order[at[b] : at[b + 1]]
                    own = [names[i] for i in mine]
                    rows.append((name, WORDS, int(b), int(at[b]), len(mine), b"".join(own), packed(np.array([len(w) for w in own], np.int32)), packed(times[mine])))
                del of, code, words, names
                seen, times = counted(keys([t for t, x in zip(texts, train, strict=True) if x])[0])
                u = counted(np.concatenate([seen, counted(keys([t for t, x in zip(texts, train, strict=True) if not x])[0])[0]]))[0]
                n = np.zeros(len(u), np.int32)
                n[np.searchsorted(u, seen)] = times
                at = np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])
                for b in np.flatnonzero(np.diff(at)):
                    mine = slice(int(at[b]), int(at[b + 1]))
                    rows.append((name, GRAMS, int(b), mine.start, mine.stop - mine.start, packed(np.diff(u[mine], prepend=np.uint64(0))), packed(n[mine]), None))
                cell, many = opened(seen, times, cuts)
                part = cell // (256 * PART)
                at = np.searchsorted(part, np.arange(int(part[-1]) + 2 if len(part) else 1))
                for b in np.flatnonzero(np.diff(at)):
                    mine = slice(int(at[b]), int(at[b + 1]))
                    rows.append((name, OPEN, int(b), 0, mine.stop - mine.start, packed(np.diff(cell[mine], prepend=0)), packed(many[mine]), None))
                if rows:
                    yield as_batch(rows)

    return payload.mapInArrow(run, SCHEMA)


def texts_of(row: dict) -> list[bytes]:
    """Normalised texts of a payload row."""
    return pa.decompress(row["c"], row["size"], "zstd", asbytes=True).split(b"\n")


def cut_counts(table: pa.Table) -> pa.Table:
    """Counts by next byte of the cut contexts of a part, over all slices."""
    rows = list(zip(*(table.column(x).to_pylist() for x in ("size", "a", "b")), strict=True))
    base = table.column("bucket")[0].as_py() * PART
    total = np.zeros(PART * 256, np.int64)
    for n, a, b in rows:
        total[np.cumsum(unpacked(a, n, np.int64)) - base * 256] += unpacked(b, n, np.int64)
    total = total.reshape(PART, 256)
    return pa.table({"context": pa.array(base + np.arange(PART), pa.int64()), "counts": pa.array([x.tobytes() for x in total], pa.binary())})


def answered(table: pa.Table, near: pa.Table, low: dict[str, np.ndarray]) -> pa.Table:
    """log10 probabilities, without their sign, of a bucket's grams, handed back to each slice."""
    sizes = table.column("size").to_pylist()
    if not sizes:
        return pa.table({"slice": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "first": pa.array([], pa.int32()), "size": pa.array([], pa.int32()), "c": pa.array([], pa.binary())})
    k = np.concatenate([np.cumsum(unpacked(a.as_py(), n, np.uint64), dtype=np.uint64) for a, n in zip(table.column("a"), sizes, strict=True)])
    n = np.concatenate([unpacked(b.as_py(), n, np.int32) for b, n in zip(table.column("b"), sizes, strict=True)])
    cut = {(d, c): np.frombuffer(x, np.int64).astype(float) for d, c, x in zip(*(near.column(x).to_pylist() for x in ("d", "c", "counts")), strict=True)}
    u, at = np.unique(k, return_inverse=True)
    del k
    out = coarse(-np.log10(probabilities(u, np.bincount(at, n, len(u)), low, cut)))[at]
    ends = np.cumsum([0, *sizes])
    back = pa.array([packed(out[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.table({"slice": table.column("slice"), "kind": pa.array([GRAMS] * len(sizes), pa.int32()), "first": table.column("first"), "size": table.column("size"), "c": back})


def added(table: pa.Table) -> pa.Table:
    """Training counts of a bucket's words over all slices, handed back to each slice; one row has the sums."""
    of = lambda c: [unpacked(x, n, np.int32) for x, n in zip(table.column(c).to_pylist(), table.column("size").to_pylist(), strict=True)]
    sizes = of("b")
    arrays = []
    for a, n in zip(table.column("a"), sizes, strict=True):
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), a.as_buffer()]))
    coded = pa.chunked_array(arrays, pa.binary()).combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(code, np.concatenate(of("c")), minlength=len(coded.dictionary)).astype(np.int64)
    out = total[code]
    ends = np.cumsum([0, *(len(n) for n in sizes)])
    n = len(sizes)
    return pa.table(
        {
            "slice": table.column("slice"), "kind": pa.array([WORDS] * n, pa.int32()), "first": table.column("first"), "size": table.column("size"),
            "c": pa.array([packed(out[ends[i] : ends[i + 1]]) for i in range(n)], pa.binary()),
            "distinct": pa.array([int((total > 0).sum()) if i == 0 else 0 for i in range(n)], pa.int64()),
            "train": pa.array([int(total.sum()) if i == 0 else 0 for i in range(n)], pa.int64()),
        }
    )


def looked_up(payload: pa.Table, counts: pa.Table, buckets: int) -> pa.Table:
    """Documents of a slice with the sums over their words and bytes."""
    if not payload.num_rows:
        return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("words", pa.int64()), ("known", pa.int64()), ("raw", pa.float64()), ("score", pa.float64()))})
    row = payload.to_pylist()[0]
    ids, texts = np.frombuffer(row["a"], np.int64), texts_of(row)
    null = np.frombuffer(row["b"], np.uint8)[: len(ids)].astype(bool)
    parts = sorted(zip(*(counts.column(x).to_pylist() for x in ("kind", "first", "size", "c")), strict=True))
    of, code, words = words_of(texts)
    total = np.zeros(len(words), np.int64)
    total[by_bucket(words, buckets)[1]] = np.concatenate([np.zeros(0, np.int64), *(unpacked(x, n, np.int64) for kind, _, n, x in parts if kind == WORDS)])
    n = total[code]
    sums = lambda v: np.bincount(of, v, minlength=len(ids)).astype(float)
    out = {"doc_id": pa.array(ids, mask=null), "words": pa.array(sums(None).astype(np.int64)), "known": pa.array(sums(n > 0).astype(np.int64)), "raw": pa.array(sums(np.log10(n + 1.0)))}
    del of, code, words, n
    each = np.concatenate([unpacked(x, n, np.float32) for kind, _, n, x in parts if kind == GRAMS])
    k, sizes = keys(texts)
    order = np.argsort(k)
    k = k[order]
    at = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]), dtype=np.int32)
    del k
    value = np.empty(len(order), np.float32)
    value[order] = each[at]
    out["score"] = pa.array(-np.add.reduceat(value, np.cumsum(sizes) - sizes, dtype=np.float64))
    return pa.table(out)


def ends_of(spark: SparkSession, edges: np.ndarray, cuts: list[np.ndarray]) -> DataFrame:
    """bucket, d, c, context (its number): the contexts that the two ends of each bucket cut."""
    base, need = 0, [(np.zeros(0, np.int64),) * 4]
    for d, contexts in enumerate(cuts, LOW + 1):
        c = edges >> np.uint64(64 - 8 * d)
        for side in (0, 1):  # the upper end of a bucket is the lower end of the next
            need.append((np.arange(len(edges)) + side, np.full(len(edges), d), c.astype(np.int64), base + np.searchsorted(contexts, c)))
        base += len(contexts)
    cols = [pa.array(np.concatenate(x), t) for x, t in zip(zip(*need, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
    return spark.createDataFrame(pa.table(dict(zip(("bucket", "d", "c", "context"), cols, strict=True)))).distinct()


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def score_texts(docs: DataFrame, held: Column | None = None, sparse: int = SPARSE, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    held = held_out() if held is None else held
    spark = docs.sparkSession
    ws = Workspace(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~held).alias("train"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("train").alias("train")).first()
    round_of = lambda c: F.pmod(F.col(c).cast("long"), F.lit(ROUNDS)).cast("int")
    kept = ws.save(prepared(rows, sparse).withColumn("round", round_of("slice")), "slices", "round")
    payload = kept.filter(F.col("kind") == PAYLOAD)
    low = spark.sparkContext.broadcast(short_counts(kept))  # all contexts of up to LOW bytes
    edges = boundaries(kept, per_bucket)
    cuts = [np.unique(edges >> np.uint64(64 - 8 * d)) for d in range(LOW + 1, LONGEST + 1)]
    buckets = partitions(size.n, 20_000)
    sent = ws.save(dealt(payload.drop("round"), buckets, edges, cuts).withColumn("round", round_of("bucket")), "dealt", "round")
    counts = sent.filter(F.col("kind") == WORDS).select("slice", "bucket", "first", "size", "a", "b", "c").groupBy("bucket")
    counts = ws.save(counts.applyInArrow(added, "slice long, kind int, first int, size int, c binary, distinct long, train long"), "counts")
    cut = sent.filter(F.col("kind") == OPEN).select("bucket", "size", "a", "b").groupBy("bucket").applyInArrow(cut_counts, "context long, counts binary")
    near = ws.save(ends_of(spark, edges, cuts).join(cut, "context").select("bucket", "d", "c", "counts"), "near")
    answers = []
    for r in range(ROUNDS):
        grams = sent.filter((F.col("kind") == GRAMS) & (F.col("round") == r)).select("slice", "bucket", "first", "size", "a", "b")
        mine = near.filter(round_of("bucket") == r)
        got = grams.groupBy("bucket").cogroup(mine.groupBy("bucket")).applyInArrow(lambda t, c: answered(t, c, low.value), "slice long, kind int, first int, size int, c binary")
        answers.append(ws.save(got.withColumn("round", round_of("slice")), "answers", "round"))
    freed(ws, sent)
    sums = counts.agg(F.sum("distinct").alias("v"), F.sum("train").alias("n")).first()
    ends = size.train
    v, n = (sums.v or 0) + (ends > 0), (sums.n or 0) + ends
    back = counts.withColumn("round", round_of("slice")).select(*answers[0].columns)
    for part in answers:
        back = back.unionByName(part)
    found = None
    for r in range(ROUNDS):
        mine = payload.filter(F.col("round") == r).select("slice", "size", "a", "b", "c").groupBy("slice").cogroup(back.filter(F.col("round") == r).drop("round").groupBy("slice"))
        one = ws.save(mine.applyInArrow(lambda p, c: looked_up(p, c, buckets), "doc_id long, words long, known long, raw double, score double"), "scored")
        found = one if found is None else found.unionByName(one)
    freed(ws, kept, *answers)
    tokens_ = F.col("words") + 1
    return found.select(
        "doc_id", held.alias("held_out"), tokens_.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("raw") + math.log10(ends + 1) - tokens_ * math.log10(n + v + 1)).alias("base_score"), "score",
    )
