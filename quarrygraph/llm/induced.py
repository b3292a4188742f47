"""External induced sorting of the suffixes of many strings, with common-prefix values.

Suffixes that start below both neighbours (S*) are sorted first: the substrings between them get names, and the string
of names is sorted by the same method again until it fits into memory. From their order two sweeps over the first
characters induce the order of all others. A sweep's tuples (position, common prefix with the one before) wait in a
priority queue that keeps only so many in memory and the rest in a file. The common prefix of two induced suffixes is
one more than the least between their sources, up to a cap.

The strings' ends are unique characters below all others, in the order of the strings. All steps work on arrays.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Items that a step holds in memory: beyond it arrays are files, queues spill and names are sorted by recursion.
MEMORY = 1 << 22


def space(n: int, dtype, memory: int) -> np.ndarray:
    """An array of n items; one backed by an unnamed file of the task where it would exceed memory."""
    if n <= memory:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:  # its space goes with the mapping
        return np.memmap(f, dtype, "w+", shape=(n,))


class Queue:
    """A monotone priority queue of (position, prefix) by bucket, first in first out within one; what exceeds memory is in a file."""

    def __init__(self, buckets: int, memory: int):
        self.held: list[list] = [[] for _ in range(buckets)]
        self.memory, self.inside, self.file, self.end = memory, 0, None, 0

    def push(self, bucket: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Items already grouped by bucket."""
        if not len(pos):
            return
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for i, j in zip(np.append(0, cuts).tolist(), np.append(cuts, len(pos)).tolist(), strict=True):
            self.held[bucket[i]].append((pos[i:j], lcp[i:j]))
        self.inside += len(pos)
        if self.inside > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for parts in self.held:
            for k, part in enumerate(parts):
                if len(part) == 2:
                    n = len(part[0])
                    self.file.write(np.ascontiguousarray(part[0], np.int64).tobytes() + np.ascontiguousarray(part[1], np.uint8).tobytes())
                    parts[k] = (self.end, n, None)
                    self.end += 9 * n
        self.inside = 0

    def pop(self, bucket: int, most: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The bucket's first items, about most of them, or with last its last push; None when it is empty."""
        parts, n, out = self.held[bucket], 0, []
        while parts and (not out or n < most):
            part = parts.pop() if last else parts.pop(0)
            if len(part) == 3:
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), np.int64), np.frombuffer(self.file.read(part[1]), np.uint8)
            else:
                self.inside -= len(part[0])
            out.append(part)
            n += len(part[0])
        if not out:
            return None
        return np.concatenate([p for p, _ in out]), np.concatenate([v for _, v in out])


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo + 1 : hi + 1]) for each pair lo < hi, by a table of doubling spans."""
    rows, k = [values], 1
    longest = int((hi - lo).max(initial=1))
    while 2 * k <= longest:
        rows.append(np.minimum(rows[-1][:-k], rows[-1][k:]))
        k *= 2
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for i in range(len(rows)):
        on = level == i
        a, b = lo[on] + 1, hi[on] - (1 << i) + 1
        out[on] = np.minimum(rows[i][a], rows[i][b])
    return out


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor (S); the last one is. A run of equal characters has the type of its last."""
    last = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
    up = np.append(t[last[:-1]] < t[last[:-1] + 1], True)
    return np.repeat(up, np.diff(np.append(-1, last)))


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    x = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.append(False, x[1:] != x[:-1]))[: len(keys)]
    return rank


def names_of(t: np.ndarray, star: np.ndarray) -> np.ndarray:
    """Order-preserving names of the substrings from each S* position to the next; one that ends earlier is greater, as its end is S."""
    bits = int(t.max() + 2).bit_length()
    per = max(1, 63 // bits)
    pad = np.int64((1 << bits) - 1)
    length = np.append(np.diff(star), 0) + 1
    rank, i = np.zeros(len(star), np.int64), np.arange(len(star))
    for k in range(0, int(length.max(initial=0)), per):
        key = np.zeros(len(i), np.int64)
        for j in range(k, k + per):
            at = np.minimum(star[i] + j, len(t) - 1)
            key = (key << np.int64(bits)) | np.where(j < length[i], t[at], pad)
        if not k:
            rank = _dense(key)
            i = np.flatnonzero(length >= per)
            continue
        # only substrings that reach here compare; their groups split, and later ranks move up by what was added
        order = np.lexsort((key, rank[i]))
        r, x = rank[i][order], key[order]
        new_group = np.append(True, r[1:] != r[:-1])
        step = np.append(False, (x[1:] != x[:-1]) & ~new_group[1:]).astype(np.int64)
        within = np.cumsum(step)
        within -= np.maximum.accumulate(np.where(new_group, within, 0))
        grown = np.zeros(int(rank.max()) + 2, np.int64)
        np.add.at(grown, r + 1, step)
        shift = np.cumsum(grown)
        rank = rank + shift[rank]
        rank[i[order]] += within
        i = i[length[i] >= k + per]
        if not len(i):
            break
    return rank


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names in memory, by ranks of doubled lengths."""
    rank, k, n = _dense(t.astype(np.int64)), 1, len(t)
    while n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        rank = _dense(rank * np.int64(n + 1) + after)
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _swept(t: np.ndarray, target: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    """One sweep over integers in rising order: the targets' order, induced from the seeds' (which follow the targets of their first character).

    A step takes a range of characters with about memory / 4 targets. Targets whose source lies in the range too follow
    from the ranks of their sources, by ranking until nothing changes.
    """
    chars = np.sort(t[target])
    ends, at = [], 0  # last character of each range
    while at < len(chars):
        last = chars[min(len(chars) - 1, at + max(1, memory // 4))]
        ends.append(int(last))
        at = int(np.searchsorted(chars, last, "right"))
    of_range = np.array(ends, np.int64)
    queue, out, filled = Queue(len(ends), memory), space(len(chars), np.int64, memory), 0
    seed_ends = np.searchsorted(t[seeds], of_range, "right")
    for i, end in enumerate(ends):
        base = [np.zeros(0, np.int64)]
        while (got := queue.pop(i, memory)) is not None:
            base.append(got[0])
        base = np.concatenate(base)
        own = seeds[seed_ends[i - 1] if i else 0 : seed_ends[i]]
        minor = np.concatenate([np.arange(len(base)), (1 << 38) + np.arange(len(own))])
        items, source, cur, off = [np.concatenate([base, own])], [np.full(len(minor), -1)], np.concatenate([base, own]), 0
        while len(cur):
            p = np.maximum(cur - 1, 0)
            keep = (cur > 0) & target[p] & (t[p] <= end)
            source.append(np.flatnonzero(keep) + off)
            off += len(cur)
            cur = p[keep]
            items.append(cur)
        pos, src = np.concatenate(items), np.concatenate(source)
        chained = src >= 0
        minor = np.append(minor, np.zeros(len(pos) - len(minor), np.int64))
        char = _dense(t[pos].astype(np.int64)) << np.int64(40)
        rank = _dense(char | minor)
        while True:
            minor[chained] = (1 << 37) + rank[src[chained]]
            new = _dense(char | minor)
            if np.array_equal(new, rank):
                break
            rank = new
        sorted_ = np.empty(len(pos), np.int64)
        sorted_[rank] = pos
        mine = sorted_[target[sorted_]]
        out[filled : filled + len(mine)] = mine
        filled += len(mine)
        p = np.maximum(sorted_ - 1, 0)
        p = p[(sorted_ > 0) & target[p] & (t[p] > end)]
        bucket = np.searchsorted(of_range, t[p])
        by = np.argsort(bucket, kind="stable")
        queue.push(bucket[by], p[by], np.zeros(len(p), np.uint8))
    return out


def order_of(t: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """Order of all suffixes of t: integers in which each string's end is a unique one below all others and the last string's end comes last."""
    if len(t) <= memory:
        return _doubled(t)
    small = smaller_types(t)
    star = np.flatnonzero(small & np.append(True, ~small[:-1]))
    stars = star[order_of(names_of(t, star), memory)]
    large = _swept(t, ~small, stars, memory)
    target, n = small.copy(), len(t) - 1
    target[n] = False  # the last end has no source: it is one of the seeds
    mirrored = t.max() - t
    seeds = large[::-1]
    seeds = np.insert(seeds, np.searchsorted(mirrored[seeds], mirrored[n]), n)
    less = np.append(_swept(mirrored, target, seeds, memory)[::-1], n)
    pos = np.concatenate([large, less])
    key = 2 * t[pos].astype(np.int64) + np.repeat([0, 1], [len(large), len(less)])
    return pos[np.argsort(key, kind="stable")]


# ---- bytes ---------------------------------------------------------------------------------------------------


def joined(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one, each string followed by a 0, and where each string starts."""
    n = len(offs) - 1
    t = np.zeros(len(data) + n, np.uint16)
    t[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offs))] = data
    start = offs[:-1] + np.arange(n)
    t += 1
    t[np.append(start[1:], len(t)) - 1] = 0
    return t, start


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b, at most cap and not beyond their strings, seven characters at a time."""
    padded = np.append(t, np.zeros(7, t.dtype)).astype(np.uint64)
    word = np.zeros(len(t), np.uint64)
    for j in range(7):
        word = (word << np.uint64(9)) | padded[j : len(t) + j]
    most = np.minimum(np.minimum(room[a], room[b]), cap).astype(np.int64)
    out, at, i = most.copy(), 0, np.flatnonzero(most > 0)
    while len(i):
        differ = word[a[i] + at] ^ word[b[i] + at]
        differ &= ~(differ >> np.uint64(1))  # the highest bit stays, and no run of ones rounds up to the next
        met = differ != 0
        j = i[met]
        # the first of the word's characters that differs, from its highest bit
        out[j] = np.minimum(most[j], at + 6 - (np.frexp(differ[met].astype(np.float64))[1] - 1) // 9)
        at += 7
        i = i[~met]
        i = i[most[i] > at]
    return out


def _run(t: np.ndarray, at: int, cap: int) -> int:
    k = 1
    while k < cap and at + k < len(t) and t[at + k] == t[at]:
        k += 1
    return k


class _Sweep:
    """Takes suffixes in order, induces the targets before them, and knows for each character the least prefix since its last target."""

    def __init__(self, t: np.ndarray, target: np.ndarray, cap: int, memory: int):
        self.t, self.target, self.cap = t, target, cap
        self.queue, self.since = Queue(257, memory), np.zeros(257, np.uint8)

    def take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        p = np.maximum(pos - 1, 0)
        sel = np.flatnonzero((pos > 0) & self.target[p])
        c = self.t[p[sel]]
        by = np.argsort(c, kind="stable")
        sel, c = sel[by], c[by]
        new = np.append(True, c[1:] != c[:-1])[: len(c)]
        value = np.empty(len(sel), np.uint8)
        at = np.flatnonzero(~new)
        value[at] = least_between(lcp, sel[at - 1], sel[at]) if len(at) else 0
        first = np.flatnonzero(new)
        value[first] = np.minimum(self.since[c[first]], np.minimum.accumulate(lcp)[sel[first]])
        self.since = np.minimum(self.since, lcp.min())
        if len(c):
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], 255).astype(np.uint8)
            last = np.append(first[1:], len(c)) - 1
            self.since[c[last]] = after[sel[last] + 1]
        self.queue.push(c, p[sel], np.minimum(value.astype(np.int16) + 1, self.cap).astype(np.uint8))


def sorted_suffixes(t: np.ndarray, cap: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of t (as joined gives it) in falling order, without the ends: pieces of (positions, common prefix with the one before, at most cap <= 255)."""
    small = smaller_types(t)
    star = np.flatnonzero(small & np.append(True, ~small[:-1]))
    end = t[star] == 0
    names = names_of(t, star)
    names = np.where(end, np.cumsum(end) - 1, names + int(end.sum()))
    stars = star[order_of(names, memory)]
    stop = np.flatnonzero(t == 0)
    room = np.repeat(stop, np.diff(np.append(-1, stop))) - np.arange(len(t))
    stars_lcp = np.append(0, _common(t, stars[:-1], stars[1:], room, cap)).astype(np.uint8)
    ends = np.searchsorted(t[stars], np.arange(258))
    up = _Sweep(t, ~small, cap, memory)
    larges = Queue(257, memory)
    last_large = np.full(257, -1)
    for c in range(257):
        begun = False
        while (got := up.queue.pop(c, memory)) is not None:
            pos, lcp = got[0], got[1].copy()
            if not begun:
                lcp[0] = 0
            begun, last_large[c] = True, pos[-1]
            larges.push(np.full(len(pos), c), pos, lcp)
            up.take(pos, lcp)
        for a in range(ends[c], ends[c + 1], memory):
            pos, lcp = stars[a : min(a + memory, ends[c + 1])], stars_lcp[a : min(a + memory, ends[c + 1])].copy()
            if a == ends[c]:
                lcp[0] = min(_run(t, last_large[c], cap), _run(t, pos[0], cap)) if begun and c else 0
            if not c:
                lcp[:] = 0
            up.take(pos, lcp)
    del up
    down = _Sweep(t, small & (t > 0), cap, memory)
    for c in range(256, 0, -1):
        last = None
        while (got := down.queue.pop(c, memory)) is not None:
            pos, lcp = got[0], got[1].copy()
            if last is None:
                lcp[0] = 0
            last = pos[-1]
            yield pos, lcp
            down.take(pos, lcp)
        carry = None
        while (got := larges.pop(c, 1, last=True)) is not None:
            pos, lcp = got[0][::-1], got[1]
            if carry is None:
                carry = 0 if last is None else min(_run(t, last, cap), _run(t, pos[0], cap))
            falling = np.append(carry, lcp[:0:-1]).astype(np.uint8)
            carry = lcp[0]
            yield pos, falling
            down.take(pos, falling)


def repeated(data: np.ndarray, offs: np.ndarray, order: np.ndarray, width: int, memory: int = MEMORY) -> np.ndarray:
    """Which bytes of strings start a string of width bytes that also starts at a place of lower order (order: one number a byte)."""
    t, start = joined(data, offs)
    dup = np.zeros(len(t), bool)
    where = np.zeros(len(t), np.int64)
    where[np.arange(len(data)) + np.repeat(np.arange(len(start)), np.diff(offs))] = order
    held = np.zeros(0, np.int64)

    def close(pos, lcp):
        begin = np.flatnonzero(lcp < width)
        least = np.repeat(np.minimum.reduceat(where[pos], begin), np.diff(np.append(begin, len(pos))))
        dup[pos[where[pos] > least]] = True

    held_lcp = np.zeros(0, np.uint8)
    for pos, lcp in sorted_suffixes(t, width, memory):
        pos, lcp = np.append(held, pos), np.append(held_lcp, lcp)
        open_ = int(np.flatnonzero(lcp < width)[-1])  # the last class may go on
        if open_:
            close(pos[:open_], lcp[:open_])
        held, held_lcp = pos[open_:], lcp[open_:]
    if len(held):
        close(held, held_lcp)
    return dup[t > 0]
