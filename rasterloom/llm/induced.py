"""Suffix order with common prefixes by induced sorting, its queues on disk beyond a bound.

The suffixes that begin a left-most S run are sorted first: their substrings by one induction, then, where names repeat,
the string of names by recursion. From them all L suffixes are induced in ascending order and from those all S suffixes
in descending order. What is induced for a symbol arrives in its order, so the priority queue is one first-in-first-out
queue for each symbol; a queue carries suffix tuples (position, common prefix with the one before it). All suffixes
that wait for a symbol are taken at once. Common prefixes are counted up to a cap: an induced pair shares one symbol more
than the least common prefix between its parents.

Positions, symbols and common prefixes have 32 bits, and what is done with goes at once: this is what limits a text.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples that the queues of one order hold in memory before the fullest go to disk.
HELD = 1 << 20


class Queues:
    """First-in-first-out queues of (position, common prefix) by symbol."""

    def __init__(self, held: int = HELD) -> None:
        self.most, self.held = held, 0
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, tuple] = {}

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append(np.stack([at, lcp]))
        self.held += len(at)
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        for symbol in sorted(self.parts, key=lambda s: -sum(p.shape[1] for p in self.parts[s]))[: max(1, len(self.parts) // 2)]:
            parts = self.parts.pop(symbol)
            file, sizes = self.files.setdefault(symbol, (tempfile.TemporaryFile(), []))  # noqa: SIM115
            for p in parts:
                file.seek(0, 2)
                file.write(np.ascontiguousarray(p, np.int32).tobytes())
                sizes.append(p.shape[1])
                self.held -= p.shape[1]

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        parts = []
        if symbol in self.files:
            file, sizes = self.files.pop(symbol)
            file.seek(0)
            parts = [np.frombuffer(file.read(8 * n), np.int32).reshape(2, n) for n in sizes]
            file.close()
        for p in self.parts.pop(symbol, []):
            parts.append(p)
            self.held -= p.shape[1]
        if not parts:
            return None
        both = np.concatenate(parts, axis=1)
        return both[0], both[1]


def kinds(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next (S), and the length of the run of its first symbol."""
    n = len(t)
    last = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # the last place of each run
    many = np.diff(np.append(-1, last))
    after = np.repeat(np.append(t[1:], t.dtype.type(-1))[last], many)
    return after > t, (np.repeat(last, many) - np.arange(n) + 1).astype(np.int32)


def induce(t: np.ndarray, s_type: np.ndarray, run: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and their common prefixes with the one before, from seeds: left-most S suffixes in order."""
    symbols, code = np.unique(t, return_inverse=True)
    code, k = code.astype(np.int32), len(symbols)
    by = code[seeds]
    first = np.searchsorted(by, np.arange(k + 1))
    large: list[tuple[np.ndarray, np.ndarray]] = []

    def push(queues: Queues, carry: np.ndarray, begun: np.ndarray, at: np.ndarray, lcp: np.ndarray, want_s: bool) -> None:
        """Hand on what precedes each suffix of a batch, with the least common prefix since the last for its symbol."""
        ok = at > 0
        before = np.where(ok, at - 1, 0)
        ok &= s_type[before] == want_s
        to = code[before]
        least = np.minimum.accumulate(lcp)
        which = np.flatnonzero(ok)
        order = which[np.argsort(to[which], kind="stable")]
        sym = to[order]
        cuts = np.flatnonzero(np.append(True, sym[1:] != sym[:-1])) if len(sym) else np.zeros(0, np.int64)
        carry_now = np.minimum(carry, least[-1])
        if len(order):
            # least over (previous of the symbol, this]
            value = np.empty(len(order), np.int32)
            tails = np.minimum.accumulate(lcp[::-1])[::-1]
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                places = order[a:b]
                c = int(sym[a])
                value[a] = min(int(carry[c]), int(least[places[0]])) if begun[c] else -1
                if len(places) > 1:
                    value[a + 1 : b] = np.minimum.reduceat(lcp, places[:-1] + 1)
                    # the last stretch of reduceat runs on to the end: cut it at its own place
                    value[b - 1] = lcp[places[-2] + 1 : places[-1] + 1].min()
                begun[c] = True
                rest = places[-1] + 1
                carry_now[c] = tails[rest] if rest < len(lcp) else cap
                queues.put(c, before[places], np.minimum(value[a:b] + 1, cap))
        carry[:] = carry_now

    queues, carry, begun = Queues(), np.full(k, cap, np.int32), np.zeros(k, bool)
    for c in range(k):
        mine: list[tuple[np.ndarray, np.ndarray]] = []
        got = queues.take(c)
        while got is not None:
            mine.append(got)
            push(queues, carry, begun, *got, False)
            got = queues.take(c)
        at = np.concatenate([np.zeros(0, np.int32), *(m[0] for m in mine)])
        lcp = np.concatenate([np.zeros(0, np.int32), *(m[1] for m in mine)])
        large.append((at, lcp))
        s, sl = seeds[first[c] : first[c + 1]], seed_lcp[first[c] : first[c + 1]].copy()
        if len(s):
            sl[0] = min(cap, run[at[-1]], run[s[0]]) if len(at) else 0
            push(queues, carry, begun, s, sl, False)
    # S suffixes, largest symbol and suffix first; a tuple's common prefix is with the suffix after it
    queues, carry, begun = Queues(), np.full(k, cap, np.int32), np.zeros(k, bool)
    none = np.zeros(0, np.int32)
    small: list[tuple[np.ndarray, np.ndarray]] = [(none, none)] * k
    for c in range(k - 1, -1, -1):
        mine = []
        got = queues.take(c)
        while got is not None:
            mine.append(got)
            push(queues, carry, begun, *got, True)
            got = queues.take(c)
        at = np.concatenate([np.zeros(0, np.int32), *(m[0] for m in mine)])
        lcp = np.concatenate([np.zeros(0, np.int32), *(m[1] for m in mine)])
        small[c] = (at, lcp)
        la, ll = large[c]
        if len(la):
            down = np.append(np.int32(min(cap, run[at[-1]], run[la[-1]]) if len(at) else 0), ll[1:][::-1])
            push(queues, carry, begun, la[::-1], down, True)
    order, common = [], []
    for (la, ll), (sa, sl) in zip(large, small, strict=True):
        order += [la, sa[::-1]]
        ll = ll.copy()
        up = np.append(np.int32(0), sl[1:][::-1]) if len(sa) else sl
        if len(ll):
            ll[0] = 0
            if len(sa):
                up[0] = min(cap, run[la[-1]], run[sa[-1]])
        common += [ll, up]
    return np.concatenate(order), np.concatenate(common)


def leftmost(s_type: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1


def doubled(names: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first `reach` names, by prefix doubling."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        follow = np.append(rank[step:] + 1, np.zeros(min(step, n), np.int64)) if step < n else np.zeros(n, np.int64)
        key = rank * (int(rank.max(initial=0)) + 2) + follow
        _, rank = np.unique(key, return_inverse=True)
        step *= 2
        if step >= reach or rank.max(initial=0) == n - 1:
            return np.argsort(rank, kind="stable")


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to cap."""
    wide = np.append(t, np.arange(-1, -cap - 2, -1, t.dtype))
    out = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    for j in range(cap):
        x, y = a[live] + j, b[live] + j
        same = (wide[np.minimum(x, len(wide) - 1)] == wide[np.minimum(y, len(wide) - 1)]) & (np.maximum(x, y) < len(t))
        live = live[same]
        if not len(live):
            break
        out[live] += 1
    return out


def suffix_order(t: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of t in order of their first `cap` symbols at least, and common prefixes up to cap.

    t holds symbols >= 0; its end counts as smaller than any symbol.
    """
    n = len(t)
    if n >= np.iinfo(np.int32).max - 1 or n and int(t.max()) >= np.iinfo(np.int32).max - 1:
        raise ValueError("positions and symbols have 32 bits")
    t = t.astype(np.int32)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int32)
    if not len(leftmost(kinds(t)[0])):
        # one descending slope after at most one ascending: induce from nothing but the end
        order = doubled(np.unique(t, return_inverse=True)[1], n)
        lcp = np.append(np.int32(0), common_prefix(t, order[:-1], order[1:], cap))
        return order, lcp
    # the last suffix is L and nothing induces it: an end mark, smaller than all, does
    t1 = np.append(t + np.int32(1), np.int32(0))
    s_type, run = kinds(t1)
    s_type[n], s_type[n - 1] = True, False
    lms = leftmost(s_type).astype(np.int32)
    by_first = lms[np.argsort(t1[lms], kind="stable")]
    ordered = induce(t1, s_type, run, by_first, np.zeros(len(lms), np.int32), cap)[0]
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ordered = ordered[is_lms[ordered]]
    names = named(t1, lms, ordered)
    top = int(names.max()) + 1
    if top == len(lms):
        sorted_lms = ordered
    elif top * 64 <= len(lms) and len(lms) < n // 2:
        sorted_lms = lms[suffix_order(names, cap)[0]]
    else:  # a round of Python for each of very many names costs more than doubling
        sorted_lms = lms[doubled(names, cap)]
    del by_first, ordered, is_lms, names
    lcp = np.append(np.int32(0), common_prefix(t1, sorted_lms[:-1], sorted_lms[1:], cap))
    order, common = induce(t1, s_type, run, sorted_lms, lcp, cap)
    keep = order < n
    return order[keep], common[keep]


def named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the substrings from each left-most S place up to the next, included: equal where these are equal."""
    n = len(t) - 1
    length = np.zeros(n + 1, np.int32)
    length[lms] = np.append(lms[1:], np.int32(n)) - lms + 1
    power = np.full(n + 2, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(n + 2, np.uint64)
    mixed = sums[1:]
    mixed[:] = t
    mixed += np.uint64(7)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(31)
    mixed *= power[: n + 1]
    np.cumsum(mixed, out=mixed)
    ends = np.minimum(ordered + length[ordered], n + 1)
    hashed = (sums[ends] - sums[ordered]) * power[n + 1 - ordered]
    fresh = np.append(True, (hashed[1:] != hashed[:-1]) | (length[ordered][1:] != length[ordered][:-1]))
    name = np.zeros(n + 1, np.int32)
    name[ordered] = np.cumsum(fresh) - 1
    return name[lms]
