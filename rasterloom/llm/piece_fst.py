"""SentencePiece encoding and decoding (3) by a weighted finite-state transducer and its shortest path.

The normaliser (a leading space, spaces written as a mark), the pieces and the byte fallback are compiled into one
transducer: a trie of pieces whose arcs end in a piece's id and weight, and for characters that no piece holds an arc to
their bytes. Composed with an input it is a lattice over positions; encoding is its shortest path in the tropical
semiring (weights add along a path, the least path wins), found by relaxing the arcs of one position after the other.

For unigram models the weight of a piece is its score's negative, and that is all. For models that merge pairs (BPE) a
sum of scores is not what the library maximises. There the transducer is composed with an acceptor of adjacent pieces,
compiled from the merge order: an arc between two pieces that merging would not leave side by side weighs infinity.
Whether it would follows from the merges that make the end of the left piece and the beginning of the right one, taken
back from the latest: if what stands side by side at some time is a piece of earlier rank than the next merge on either
side, merging joins it. No merge is run on the input. A state of that lattice is a position and its last piece; one
path of finite weight leads to each position, so the shortest path is the library's.

No piece has the mark behind another character (checked when compiling), so a text is cut before each run of marks;
between letters and other characters it is cut where no piece joins them. Paths of short parts are kept in a bounded
cache. Decoding joins pieces, bytes and marks back to text.

Null and empty texts have no pieces. Repeated rows are encoded one by one; extra columns are left aside.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices

MARK, CACHE, SHORT = "▁", 300_000, 64


class Transducer:
    """A compiled model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unk = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.output = [bytes([byte_of[i]]) if i in byte_of else b"" if sp.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds the space mark behind another character")
        # the normaliser as the library applies it: what it does to probes is what is compiled
        probe = sp.normalize("a  b")
        self.lead = MARK if probe.startswith(MARK) else ""
        if probe != f"{self.lead}a{MARK}{MARK}b" or sp.normalize("ﬁ\tA") != f"{self.lead}ﬁ\tA":
            raise ValueError("only an identity normaliser with an optional leading space is compiled")
        # scores that are those of a merge order mean a merging model
        self.merges = all(x <= 0 and x == int(x) for x in self.score.values())
        self.weight = {p: -x for p, x in self.score.items()}
        self.unknown = max(self.weight.values(), default=0.0) + 10
        self.made = {p: self.last_merge(p) for p in self.id if len(p) > 1} if self.merges else {}
        self.trie: dict = {}
        for p in self.id:
            if self.made.get(p, p) is None:
                continue  # merging never makes it
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        # no piece joins a letter or digit to another character, but for those taken out here: a part ends between them
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1) if p[i] != MARK}
        out = "".join(sorted({c for two in pairs if two[0].isalnum() != two[1].isalnum() for c in two if c.isalnum()}))
        self.part = re.compile(f"{MARK}*[^\\W_{re.escape(out)}]+|{MARK}*(?:[^\\w{MARK}]|[_{re.escape(out)}])+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def normal(self, text: str) -> str:
        return self.lead + text.replace(" ", MARK) if text else ""

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that merging joins last to make a piece, None if it does not make it."""
        few, weight, last = list(piece), self.weight.get, None
        while len(few) > 1:
            least, at = None, 0
            for i in range(len(few) - 1):
                w = weight(few[i] + few[i + 1])
                if w is not None and (least is None or w < least):
                    least, at = w, i
            if least is None:
                return None
            last = (few[at], few[at + 1])
            few[at : at + 2] = [few[at] + few[at + 1]]
        return last

    def adjacent(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b side by side: the acceptor that a merging model is composed with.

        Merges are taken back from the latest; of equal ranks the left one comes first.
        """
        weight, made, limit, x, y = self.weight.get, self.made, math.inf, a, b
        while True:
            both = weight(x + y)
            if both is not None and both < limit:
                ok = False
                break
            one, two = weight(x) if len(x) > 1 else -1.0, weight(y) if len(y) > 1 else -1.0
            if one < 0 and two < 0:
                ok = True
                break
            if one > two:
                limit, x = one, made[x][1]
            else:
                limit, y = two + 0.5, made[y][0]
        if len(self.pairs) > 4 * CACHE:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def path(self, part: str) -> list[str]:
        """Pieces and single unknown characters on the shortest path through the lattice of one part."""
        n, trie, weight, pairs, merges = len(part), self.trie, self.weight.get, self.pairs, self.merges
        best, last = [0.0] + [math.inf] * n, [""] * (n + 1)  # weight of the path to each position, and its last piece
        unknown = self.unknown
        for i in range(n):
            if best[i] == math.inf:
                continue
            node, before, j, found = trie, last[i], i, False
            while j < n:
                node = node.get(part[j])
                if node is None:
                    break
                j += 1
                p = node.get("")
                if p is None:
                    continue
                found = True
                if merges and i:
                    ok = pairs.get((before, p))
                    if not (self.adjacent(before, p) if ok is None else ok):
                        continue
                w = best[i] + weight(p)
                if w < best[j]:
                    best[j], last[j] = w, p
            if not found or "" not in trie.get(part[i], ()):  # a character that no piece holds
                w = best[i] + unknown
                if w < best[i + 1] and not (merges and i and not self.adjacent(before, part[i])):
                    best[i + 1], last[i + 1] = w, part[i]
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def ids(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        out = []
        for part in self.part.findall(self.normal(text)):
            got = self.known.get(part)
            if got is None:
                got = self.coded(part)
                if len(part) <= SHORT:
                    if len(self.known) > CACHE:
                        self.known.clear()
                    self.known[part] = got
            out.append(got)
        return b"".join(out)

    def coded(self, part: str) -> bytes:
        ids = array("i")
        for p in self.path(part):
            if p in self.id:
                ids.append(self.id[p])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in p.encode())
            else:
                ids.append(self.unk)
        return ids.tobytes()

    def decode(self, ids: bytes) -> str:
        """Text of ids: the transducer read from its output side."""
        text = b"".join(map(self.output.__getitem__, array("i", ids))).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.lead and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """The transducer of a model, kept by a Python worker from task to task."""
    return Transducer(path)


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as 32-bit little-endian numbers), round_trip (whether decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(path)
        for batch in batches:
            for part in slices(batch, "text"):
                cols: dict[str, list] = {"n": [], "sha": [], "same": [], "ids": []}
                for t in part.column("text").to_pylist():
                    t = t or ""
                    ids = fst.ids(t)
                    cols["n"].append(len(ids) // 4)
                    cols["sha"].append(hashlib.sha256(ids).hexdigest())
                    cols["same"].append(fst.decode(ids) == t)
                    cols["ids"].append(array("i", ids).tolist() if keep_ids else None)
                out = {"doc_id": part.column("doc_id"), "n_pieces": pa.array(cols["n"], pa.int64()), "ids_sha256": pa.array(cols["sha"], pa.string()), "round_trip": pa.array(cols["same"], pa.bool_())}
                if keep_ids:
                    out["ids"] = pa.array(cols["ids"], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(path)
        for batch in batches:
            text = [None if i is None else fst.decode(array("i", i).tobytes()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(text, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
