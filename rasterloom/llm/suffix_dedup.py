"""Suffix-array dedup (9): bytes covered by a string of `length` bytes that also starts earlier are removed.

Every window of `length` bytes has the least hash of its inner strings of GRAM bytes; equal windows have equal ones. A
stretch of windows with the same least hash is a run, with one hash as its value. Runs whose value occurs in no other
document, nor twice in their own, hold no repeated window (equal documents are counted too, which only looks at more). The values of all runs are compared in buckets, by slices
that get one bit back for each run; no filter is broadcast. Documents with equal bytes are settled first: all but the
first are removed whole.

The strings of the runs that are left meet by value in shards. Equal strings keep their first place alone. Distinct
strings that share a value are put in suffix order with common prefixes by induced sorting (see induced), some PART of
bytes at a time, values whole; suffixes with a common prefix of `length` are one window, whose first place stays. Places
are compared by document id, then start; strings are judged on the input.

A value of very many runs is parted before it is dealt, one of more than PART bytes before it is sorted: its strings are
cut into runs of the least hash of longer inner strings (FINER), down to single windows. Equal windows have equal ones
there too, so they stay together, whatever is cut. Pieces with equal fingerprints keep their first place alone.

Null and empty texts have no bytes and lose none. A row with a null id is compared with nothing. Rows that repeat an id
are one document: the smallest text stands for it, and each row gets its result. Very long texts are one slice each.
An empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace, as_bytes, freed, partitions, slices
from rasterloom.llm.induced import suffix_order

GRAM, SLICE, SHARD = 24, 2 << 20, 4 << 20
#: Bytes of strings that are put in suffix order at a time: induced sorting holds some hundred times as much.
PART = 1 << 20
#: Parts of `length` that longer inner strings have, and the runs of one value from which on they part it before the shuffle.
FINER = ((0.64, 1 << 10), (0.88, 1 << 15), (0.96, 1 << 20), (1, 1 << 62))
#: Bytes of text whose runs' values are compared in one bucket.
BUCKET = 64 << 20
PLACE = np.uint64((1 << 28) - 1)
DOCS = "doc_id long, n long, fp binary, sha string"


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Of each string of `gram` bytes."""
    h, step, base = buf.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    parts = {}
    while step <= gram:
        parts[step] = h
        if len(h) <= step:
            break
        h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
    n = len(buf) - gram + 1
    out, at = np.zeros(n, np.uint64), 0
    for s in sorted(parts, reverse=True):
        if gram - at >= s and gram & s:
            out = out * np.uint64(pow(base, s, 1 << 64)) + parts[s][at : at + n]
            at += s
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def runs(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, windows, value of each run, and whether it may repeat within its document."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not (sizes >= length).any():
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    h = hashes(buf, gram)
    place = np.arange(len(h), dtype=np.uint64)
    top = h & ~PLACE
    width = length - gram + 1
    left = (least(top | place, width) & PLACE).astype(np.int64)
    right = (PLACE - (least(top | (PLACE - place), width) & PLACE)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    has = np.flatnonzero(sizes >= length)
    many = sizes[has] - length + 1
    doc = np.repeat(has, many)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    window = starts[doc] + at
    value = h[left[window]]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(window)))
    doc, at, value = doc[first], at[first], value[first]
    twice = left[window[first]] != right[window[first + n - 1]]
    order = np.lexsort((value, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return doc, at, n, value, twice


def finer(texts: list[bytes], values: np.ndarray, length: int, part: float) -> tuple[np.ndarray, ...]:
    """Strings cut into runs of longer inner strings, as `runs` says; the value of the whole is part of each one's."""
    of, at, n, value, twice = runs(texts, length, max(GRAM, round(part * length)))
    return of, at, n, values[of] * np.uint64(0x9E3779B97F4A7C15) + value, twice


RUNS = "slice long, bucket int, docs binary, starts binary, windows binary, values binary, tags binary"


def described(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """For each slice of texts a row (bucket -1) with ids, sizes, fingerprints, digests, and its runs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = as_bytes(part.column("text"))
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                fps = [xxhash.xxh3_128_digest(t) for t in texts]
                doc, at, n, value, twice = runs([b"" if z else t for t, z in zip(texts, null, strict=True)], length)
                bucket = (value % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                name = uuid.uuid4().int >> 66
                shas = b"".join(hashlib.sha256(t).digest() for t in texts)
                rows = [(name, -1, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), null.astype(np.uint8).tobytes(), b"".join(fps), shas)]
                for b in np.flatnonzero(np.diff(edges)):
                    o = order[edges[b] : edges[b + 1]]
                    rows.append((name, int(b), doc[o].astype(np.uint32).tobytes(), at[o].astype(np.uint32).tobytes(), n[o].astype(np.uint32).tobytes(), value[o].tobytes(), np.packbits(twice[o]).tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["slice", "bucket", "docs", "starts", "windows", "values", "tags"])

    return docs.mapInArrow(run, RUNS)


def unpacked(kept: DataFrame) -> DataFrame:
    """A row for each document of the slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, null = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["windows"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, mask=null), "n": pa.array(np.frombuffer(row["starts"], np.int64)),
                        "fp": pa.array([row["values"][16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()),
                        "sha": pa.array([row["tags"][32 * i : 32 * i + 32].hex() for i in range(len(ids))], pa.string()),
                    }
                )

    return kept.filter("bucket = -1").select("docs", "starts", "windows", "values", "tags").mapInArrow(run, DOCS)


def shared_values(table: pa.Table) -> pa.Table:
    """For each slice of a bucket, one bit for each run: whether its value is shared; and of those how often to part it."""
    values = [np.frombuffer(v, np.uint64) for v in table.column("values").to_pylist()]
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(v)) for t, v in zip(table.column("tags").to_pylist(), values, strict=True)]).astype(bool)
    value = np.concatenate(values)
    order = np.argsort(value)
    v = value[order]
    next_same = np.append(v[1:] == v[:-1], False)
    hit = np.empty(len(v), bool)
    hit[order] = next_same | np.append(False, next_same[:-1])
    hit |= twice
    first = np.flatnonzero(np.append(True, ~next_same[:-1])[: len(v)])
    many = np.diff(np.append(first, len(v)))
    level = np.empty(len(v), np.uint8)
    level[order] = np.repeat(np.searchsorted([m for _, m in FINER], many), many)
    edges = np.cumsum([0, *(len(x) for x in values)])
    own = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "hit": pa.array([np.packbits(hit[o]).tobytes() for o in own], pa.binary()), "levels": pa.array([level[o][hit[o]].tobytes() for o in own], pa.binary())})


def kept_runs(mine: pa.Table, bits: pa.Table) -> pa.Table:
    """The shared runs of each document of a slice."""
    ids, null = np.zeros(0, np.int64), np.zeros(0, bool)
    hits = {b: x for b, *x in zip(*(bits.column(c).to_pylist() for c in ("bucket", "hit", "levels")), strict=True)}
    parts: list[tuple[np.ndarray, ...]] = []
    for row in mine.to_pylist():
        if row["bucket"] < 0:
            ids, null = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["windows"], np.uint8).astype(bool)
        elif row["bucket"] in hits:
            doc = np.frombuffer(row["docs"], np.uint32)
            hit, level = (np.frombuffer(x, np.uint8) for x in hits[row["bucket"]])
            hit = np.unpackbits(hit, count=len(doc)).astype(bool)
            parts.append((doc[hit], *(np.frombuffer(row[c], kind)[hit] for c, kind in (("starts", np.uint32), ("windows", np.uint32), ("values", np.uint64))), level))
    if not any(len(p[0]) for p in parts):
        return pa.table({"doc_id": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("starts", "windows", "values", "levels")}})
    doc, at, n, value, level = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, doc))
    doc, at, n, value, level = doc[order], at[order], n[order], value[order], level[order]
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(cut[1:], len(doc))
    blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())
    return pa.table({"doc_id": pa.array(ids[doc[cut]]), "starts": blobs(at), "windows": blobs(n), "values": blobs(value), "levels": blobs(level)})


def strings(joined: DataFrame, shards: int, length: int) -> DataFrame:
    """Strings of runs by shard: each once for a slice, with the slice's first place that holds it.

    All other places of the slice are later than that one, whatever else there is: they are stretches already (ids,
    starts and ends in `done`), dealt by slice, so that a passage of very many documents fills no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text, ids, at, n, values, levels = [], [], [], [], [], []
                for t, i, a, w, v, z in zip(as_bytes(part.column("text")), part.column("doc_id").to_pylist(), *(part.column(c).to_pylist() for c in ("starts", "windows", "values", "levels")), strict=True):
                    a, w = np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(w, np.uint32).astype(np.int64)
                    text += [t[s:e] for s, e in zip(a.tolist(), (a + w + length - 1).tolist(), strict=True)]
                    ids.append(np.full(len(a), i, np.int64))
                    at.append(a)
                    n.append(w + length - 1)
                    values.append(np.frombuffer(v, np.uint64))
                    levels.append(np.frombuffer(z, np.uint8))
                if not text:
                    continue
                ids_, at_, n_, value, level = (np.concatenate(x) for x in (ids, at, n, values, levels))
                for k, (share, _) in enumerate(FINER):
                    if not (level > k).any():
                        break
                    stay, cut = np.flatnonzero(level <= k), np.flatnonzero(level > k)
                    of, inner, windows, fine, _ = finer([text[c] for c in cut], value[cut], length, share)
                    of = cut[of]
                    text = [text[c] for c in stay] + [text[c][s:e] for c, s, e in zip(of.tolist(), inner.tolist(), (inner + windows + length - 1).tolist(), strict=True)]
                    ids_, at_, level = (np.append(x[stay], y) for x, y in ((ids_, ids_[of]), (at_, at_[of] + inner), (level, level[of])))
                    n_, value = np.append(n_[stay], windows + length - 1), np.append(value[stay], fine)
                coded = pa.array(text, pa.binary()).dictionary_encode()
                del text
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.lexsort((at_, ids_, code))
                code, ids_, at_, n_, value = code[order], ids_[order], at_[order], n_[order], value[order]
                head = np.append(True, code[1:] != code[:-1])
                cut, rest = np.flatnonzero(head), np.flatnonzero(~head)
                own = value[cut]
                shard = ((own >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
                names = coded.dictionary.to_pylist()
                by = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.append(True, shard[by][1:] != shard[by][:-1]))
                rows = []
                for group in np.split(by, edges[1:]):
                    places, mine = cut[group], [names[c] for c in code[cut[group]]]
                    rows.append((int(shard[group[0]]), b"".join(mine), np.array([len(m) for m in mine], np.int64).tobytes(), own[group].tobytes(), ids_[places].tobytes(), at_[places].tobytes(), None))
                if len(rest):
                    known = merged(ids_[rest], at_[rest], at_[rest] + n_[rest])
                    rows.append((int(own[0] >> np.uint64(8)) % shards, b"", b"", b"", b"", b"", np.concatenate(known).tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["shard", "bytes", "sizes", "values", "ids", "starts", "done"])

    return joined.select("doc_id", "text", "starts", "windows", "values", "levels").mapInArrow(run, "shard long, bytes binary, sizes binary, values binary, ids binary, starts binary, done binary")


def merged(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching stretches of each document."""
    if not len(ids):
        return ids, start, end
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    doc = np.cumsum(np.append(0, ids[1:] != ids[:-1]))
    shift = doc * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.append(True, (start + shift)[1:] > reach[:-1]))
    return ids[first], start[first], (reach - shift)[np.append(first[1:], len(ids)) - 1]


def later(table: pa.Table, length: int) -> pa.Table:
    """Stretches of a shard that also start earlier."""
    kind = {"values": np.uint64}
    flat = {c: np.concatenate([np.frombuffer(x, kind.get(c, np.int64)) for x in table.column(c).to_pylist()]) for c in ("sizes", "values", "ids", "starts")}
    offsets = np.append(0, np.cumsum(flat["sizes"]))
    coded = pa.Array.from_buffers(pa.large_binary(), len(flat["sizes"]), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(b"".join(x.as_py() for x in table.column("bytes")))]).dictionary_encode()
    string = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    k, names = len(coded.dictionary), coded.dictionary
    del coded
    size, value = np.zeros(k, np.int64), np.zeros(k, np.uint64)
    size[string], value[string] = flat["sizes"], flat["values"]
    order = np.lexsort((flat["starts"], flat["ids"], string))
    string, ids, start = string[order], flat["ids"][order], flat["starts"][order]
    head = np.append(True, string[1:] != string[:-1])[: len(string)]
    out = [(ids[~head], start[~head], start[~head] + size[string[~head]])]
    out += [tuple(np.frombuffer(d, np.int64).reshape(3, -1)) for d in table.column("done").to_pylist() if d is not None]
    first_id, first_at = ids[head], start[head]
    # strings that share a value with another, or hold their own least hash twice
    by = np.argsort(value, kind="stable")
    fresh = value[by][1:] != value[by][:-1]
    alone = (np.append(True, fresh) & np.append(fresh, True))[:k]
    inner = size - length + 1 > length - GRAM + 1
    chosen = np.sort(by[~alone | inner[by] | may_repeat(names, by, length)])
    parts, known = parted(names, chosen, size[chosen], value[chosen], first_id, first_at, length)
    out += known
    for of, at, lens in parts:
        begin = np.cumsum(lens + 1) - lens - 1
        t = np.zeros(int((lens + 1).sum()), np.int32)
        body = np.frombuffer(b"".join(names[i].as_py()[a:b] for i, a, b in zip(of.tolist(), at.tolist(), (at + lens).tolist(), strict=True)), np.uint8)
        inside = np.ones(len(t), bool)
        inside[begin + lens] = False
        t[inside] = body
        t[inside] += 1
        sa, lcp = suffix_order(t, length)
        which = np.searchsorted(begin, sa, side="right") - 1
        full = sa + length <= begin[which] + lens[which]
        group = np.cumsum(lcp < length)[full]
        where, which = sa[full], which[full]
        doc, place = first_id[of[which]], first_at[of[which]] + at[which] + where - begin[which]
        o = np.lexsort((place, doc, group))
        rest = o[1:][group[o][1:] == group[o][:-1]]
        out.append(merged(doc[rest], place[rest], place[rest] + length))
    ids, start, end = merged(*(np.concatenate(x) for x in zip(*out, strict=True)))
    return pa.table({"doc_id": ids, "s": start, "e": end})


def parted(names: pa.Array, of: np.ndarray, size: np.ndarray, value: np.ndarray, first_id: np.ndarray, first_at: np.ndarray, length: int) -> tuple[list[tuple[np.ndarray, ...]], list[tuple[np.ndarray, ...]]]:
    """Parts of some PART of bytes, whole values together (which string, from where in it, how many bytes), and stretches.

    The strings of a value that is larger are cut (see finer) until none is; of equal pieces all but the first are
    stretches that also start earlier, and what then has a value alone goes.
    """
    at, known = np.zeros(len(of), np.int64), []

    def once(of: np.ndarray, at: np.ndarray, size: np.ndarray, value: np.ndarray, twice: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
        doc, place = first_id[of], first_at[of] + at
        order = np.lexsort((place, doc, fp[:, 1], fp[:, 0]))
        new = np.append(True, (fp[order][1:] != fp[order][:-1]).any(1))[: len(order)]
        rest, keep = order[~new], order[new]
        known.append(merged(doc[rest], place[rest], place[rest] + size[rest]))
        return tuple(x[keep] for x in (of, at, size, value, twice, fp))

    for share, _ in FINER:
        each, group = np.unique(value, return_inverse=True)
        large = (np.bincount(group, weights=size + 1, minlength=len(each)) > PART)[group]
        if not large.any():
            break
        cut, found = np.flatnonzero(large), []
        for mine in np.split(cut, np.flatnonzero(np.diff(np.cumsum(size[cut]) // PART)) + 1):
            texts = [names[int(of[i])].as_py()[at[i] : at[i] + size[i]] for i in mine]
            which, inner, windows, fine, twice = finer(texts, value[mine], length, share)
            if share == 1:
                inner = np.repeat(inner - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
                which, fine, windows = np.repeat(which, windows), np.repeat(fine, windows), np.ones(len(inner), np.int64)
                twice = np.zeros(len(inner), bool)
            fps = b"".join(xxhash.xxh3_128_digest(texts[w][a:b]) for w, a, b in zip(which.tolist(), inner.tolist(), (inner + windows + length - 1).tolist(), strict=True))
            found.append(once(of[mine[which]], at[mine[which]] + inner, windows + length - 1, fine, twice, np.frombuffer(fps, np.uint64).reshape(-1, 2)))
        of_, at_, size_, value_, twice, _ = once(*(np.concatenate(x) for x in zip(*found, strict=True)))
        _, group, many = np.unique(value_, return_inverse=True, return_counts=True)
        keep = (many > 1)[group] | twice
        of, at, size, value = (np.append(x[~large], y[keep]) for x, y in ((of, of_), (at, at_), (size, size_), (value, value_)))
    order = np.argsort(value, kind="stable")
    fresh = np.append(True, value[order][1:] != value[order][:-1])[: len(order)]
    part = np.cumsum(size[order] + 1) // PART
    part = np.maximum.accumulate(np.where(fresh, part, 0)) if len(order) else part
    return [(of[mine], at[mine], size[mine]) for mine in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(mine)], known


def may_repeat(names: pa.Array, which: np.ndarray, length: int) -> np.ndarray:
    """Whether a string could hold a window twice: a probe of `length` bytes less one step finds its first bytes again."""
    out = np.zeros(len(which), bool)
    for j, i in enumerate(which.tolist()):
        b = names[i].as_py()
        # a window twice means its first bytes twice, at a distance below the number of windows
        n = len(b) - length + 1
        mid = b[n - 1 : length]  # the bytes that all windows share
        out[j] = n > 1 and (len(mid) < 8 or b.find(mid, 0, n - 1 + len(mid) - 1) >= 0 or b.find(mid, n) >= 0)
    return out


def intervals(docs: DataFrame, length: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (DOCS, with `copy`: equal to an earlier document), and stretches s, e to remove by doc_id."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = ws.save(described(docs, length, partitions(size, BUCKET)), "runs")
    every = ws.save(unpacked(kept), "docs")
    real = every.filter("doc_id is not null")
    first = ws.save(real.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    bits = ws.save(kept.filter("bucket >= 0").select("slice", "bucket", "values", "tags").groupBy("bucket").applyInArrow(shared_values, "slice long, bucket int, hit binary, levels binary"), "bits")
    cells = kept.select("slice", "bucket", "docs", "starts", "windows", "values")
    found = cells.groupBy("slice").cogroup(bits.groupBy("slice")).applyInArrow(kept_runs, "doc_id long, starts binary, windows binary, values binary, levels binary")
    found = ws.save(found.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi"), "found")
    freed(ws, kept, bits)
    windows = found.agg(F.sum(F.length("windows") / 4 * (length + 40))).first()[0] or 0
    shards = partitions(int(windows), SHARD)
    rows = strings(docs.join(found, "doc_id"), shards, length)
    cut = ws.save(rows.groupBy("shard").applyInArrow(lambda t: later(t, length), "doc_id long, s long, e long"), "cut")
    freed(ws, found)
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return every.join(first, "fp", "left").select("doc_id", "n", "sha", copy.alias("copy")), cut


def one_each(docs: DataFrame) -> DataFrame:
    """doc_id, text: a row for each id; rows that repeat one are put together only where there are any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not repeated(docs):
        return rows
    some = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return some.union(rows.filter("doc_id is null"))


def cut_texts(docs: DataFrame, cut: DataFrame, whole: bool) -> DataFrame:
    """doc_id, removed, spans, sha and, if whole, text, of the documents with stretches to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, shas, texts = [], [], [], []
            for t, at in zip(as_bytes(batch.column("text")), batch.column("at").to_pylist(), strict=True):
                s, e = np.array([x["s"] for x in at], np.int64), np.array([x["e"] for x in at], np.int64)
                _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                left = b"".join(t[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(t)], strict=True))
                removed.append(int((e - s).sum()))
                spans.append(len(s))
                shas.append(hashlib.sha256(left).hexdigest())
                texts.append(whole_characters(t, s, e) if whole else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.int64()), "kept": pa.array(shas, pa.string()), "clean": pa.array(texts, pa.string())})

    by = cut.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("at"))
    return docs.join(by, "doc_id").select("doc_id", "text", "at").mapInArrow(run, "doc_id long, removed long, spans long, kept string, clean string")


def whole_characters(t: bytes, s: np.ndarray, e: np.ndarray) -> str:
    """The text without the stretches, a character that is cut staying whole."""
    out, at = [], 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        while a < b and t[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(t) and t[b] & 0xC0 == 0x80:
            b -= 1
        out.append(t[at:a])
        at = b
    return (b"".join(out) + t[at:]).decode()


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    ws = Workspace(docs.sparkSession)
    rows = one_each(docs)
    every, cut = intervals(rows, length, ws)
    parts = ws.save(cut_texts(rows, cut, False), "parts")
    out = every.join(parts, "doc_id", "left")
    gone = F.col("copy") & (F.col("n") >= length)
    out = out.select(
        "doc_id", F.col("n").alias("n_bytes"), F.when(gone, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
    if not repeated(docs):
        return out
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    return ids.join(out, "doc_id").unionByName(out.filter("doc_id is null"))


def repeated(docs: DataFrame) -> bool:
    ids = docs.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    return ids.n != ids.d


def clean(docs: DataFrame, length: int = 100, columns: tuple[str, ...] = ("text", "lang", "source", "n_chars")) -> DataFrame:
    """The documents without what starts earlier; those with nothing left go."""
    ws = Workspace(docs.sparkSession)
    rows = one_each(docs)
    every, cut = intervals(rows, length, ws)
    parts = ws.save(cut_texts(rows, cut, True).select("doc_id", "clean"), "parts")
    copies = every.filter(F.col("copy") & (F.col("n") >= length)).select("doc_id")
    out = docs.join(copies, "doc_id", "left_anti").join(parts, "doc_id", "left").filter("clean is null or clean <> ''")
    new = {"text": F.coalesce("clean", "text"), "n_chars": F.coalesce(F.length("clean").cast("long"), F.col("n_chars"))}
    return out.select("doc_id", *[new[c].alias(c) if c in new else F.col(c) for c in columns])
