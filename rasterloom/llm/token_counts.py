"""Token counts (10): a vocabulary's tokens of whole texts, huge documents by overlap resynchronisation.

A document of more than `huge` characters is encoded in overlapping chunks with offsets. Two chunks are spliced at
the last boundary in their overlap that is the start of a pre-token in both and that the left chunk's end cannot have
changed. The pre-tokeniser reads left to right and looks ahead, never behind; merges never cross a pre-token. So where
both start a pre-token at the same place, all that follows is as in the whole text. Where there is no such boundary
the overlap is widened, and then the chunk, up to the rest of the document.

Other documents are cut where a space or a line feed follows another character: a pre-token boundary in any text.
Counts of such units are kept per worker in a bounded cache. Documents with other white space or with the
vocabulary's special strings go through the library as they are.

Null and empty texts count 0. Repeated rows are counted one by one. Extra columns are left aside.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices

HUGE, CHUNK, OVERLAP, GUARD, CACHE = 1 << 16, 1 << 15, 1 << 10, 64, 400_000
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
#: White space besides the space and the line feed, by any library's reckoning.
ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​⁠﻿]")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def starts(enc, base: int) -> list[int]:
    """Offsets in the document at which pre-tokens begin."""
    found, last = [], object()
    for (a, _), w in zip(enc.offsets, enc.word_ids, strict=True):
        if w != last or w is None:
            found.append(base + a)
        last = w
    return found


def encode_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> list[int]:
    """Ids of a text, encoded chunk by chunk; the same as encoding it at once."""
    ids: list[int] = []
    begin, size, end = 0, chunk, min(chunk, len(text))
    left = tok.encode(text[:end], add_special_tokens=False)
    while True:
        if end == len(text):
            return ids + left.ids
        found = starts(left, begin)
        sure = {p for p in found[:-2] if begin < p <= end - guard}
        lap, splice = overlap, None
        while sure and splice is None:
            back = max(begin + 1, end - lap)
            to = min(len(text), back + max(size, 2 * lap))
            right = tok.encode(text[back:to], add_special_tokens=False)
            common = [p for p in starts(right, back) if p in sure and p >= min(back + guard, max(sure))]
            if common and to > end:
                splice = common[-1]
            elif back == begin + 1:
                break
            else:
                lap *= 2
        if splice is None:  # no boundary at all: a longer chunk from the same start
            size *= 2
            end = min(len(text), begin + size)
            left = tok.encode(text[begin:end], add_special_tokens=False)
            continue
        ids += [i for i, (a, _) in zip(left.ids, left.offsets, strict=True) if begin + a < splice]
        # the right chunk from the splice on is the next left chunk
        begin, end, size = splice, to, chunk
        left = Tail(right, splice - back)


class Tail:
    """An encoding from a pre-token boundary on, with offsets from there."""

    def __init__(self, enc, start: int) -> None:
        k = next((i for i, (a, _) in enumerate(enc.offsets) if a >= start), len(enc.ids))
        self.ids, self.word_ids = enc.ids[k:], enc.word_ids[k:]
        self.offsets = [(a - start, b - start) for a, b in enc.offsets[k:]]


class Counter:
    """Counts of tokens, with a bounded cache of units."""

    def __init__(self, path: str, huge: int = HUGE, cache: int = CACHE) -> None:
        self.tok, self.huge, self.most, self.known = load(path), huge, cache, {}
        added = self.tok.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plain: dict[int, list[str]] = {}
        whole: list[int] = []
        for i, t in enumerate(texts):
            if len(t) > self.huge:
                out[i] = len(encode_long(self.tok, t))
            elif ODD.search(t) or any(s in t for s in self.special):
                whole.append(i)
            else:
                plain[i] = UNIT.findall(t)
        if len(self.known) > self.most:
            self.known.clear()
        new = list({u for units in plain.values() for u in units if u not in self.known})
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.known.update(zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        for i, units in plain.items():
            out[i] = sum(map(self.known.__getitem__, units))
        for i, e in zip(whole, self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, huge)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = counter.counts(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
