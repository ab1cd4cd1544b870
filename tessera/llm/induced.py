"""External induced sorting: suffixes and their common prefixes, with text, queues and output on disk.

A suffix travels as a tuple (place, common prefix). Tuples reach the queue of their first symbol already in the order
of their ranks, so one first-in-first-out queue for each symbol makes a priority queue; it holds what the suffix has in
common with the one queued before it: one more than the least common prefix of the sources in between. Large suffixes
are induced in ascending order of symbols, small ones in descending order, which is the order of the output.

The leftmost small suffixes that start the induction are sorted by recursion: a first induction sorts and names their
substrings (equal ones are carried as such), the string of names is sorted by the same functions, and its common
prefixes become those of the names' text. Arrays beyond a budget of memory are files in the task's temporary folder,
unlinked at once; what stays in memory are blocks of tuples.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of an array that may stay in memory, and tuples that are moved at once.
MEMORY, BLOCK = 64 << 20, 1 << 16
#: Symbols that are tried together at least.
LEAST = 32
#: Common prefixes from here on say that substrings are equal.
EQUAL, MOST = np.uint16(1 << 15), np.uint16(0xFFFF)

Stream = Iterator[tuple[np.ndarray, np.ndarray]]


def scratch(n: int, kind, memory: int = MEMORY) -> np.ndarray:
    """An array that is a file of its own if it is beyond the memory."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile(prefix="suffixes-") as file:
        return np.memmap(file, kind, "w+", shape=(n,))


def blocks(a: int, b: int, step: int) -> Iterator[tuple[int, int]]:
    for i in range(a, b, step):
        yield i, min(b, i + step)


def ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def tally(counts: np.ndarray, symbols: np.ndarray) -> None:
    if len(counts) <= len(symbols):
        counts += np.bincount(symbols, minlength=len(counts))
    else:
        own, times = np.unique(symbols, return_counts=True)
        counts[own] += times


def begins(counts: np.ndarray, memory: int) -> np.ndarray:
    """Where each symbol's tuples begin, and where the last ones end."""
    out = scratch(len(counts) + 1, np.int64, memory)
    np.cumsum(counts, out=out[1:])
    return out


def copied(x: np.ndarray, memory: int) -> np.ndarray:
    out = scratch(len(x), x.dtype, memory)
    out[:] = x
    return out


def places(symbols: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by symbol (stable), where each symbol begins in it, and places at the queues' ends, which move on."""
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    count = np.diff(np.append(first, len(order)))
    to = np.repeat(tail[sorted_[first]] - first, count) + np.arange(len(order))
    tail[sorted_[first]] += count
    return order, first, to


def range_minimum(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of x[a : b] for each pair a < b."""
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    table = np.empty((int(level.max()) + 1, len(x)), x.dtype)
    table[0] = x
    for k in range(1, len(table)):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, : len(x) - 2 * half + 1], table[k - 1, half : len(x) - half + 1], out=table[k, : len(x) - 2 * half + 1])
    return np.minimum(table[level, a], table[level, b - (1 << level)])


class Queues:
    """A queue of tuples for each symbol in one array, each of a known length; fed by sources in the order of their ranks."""

    def __init__(self, counts: np.ndarray, memory: int):
        self.start = begins(counts, memory)
        self.head, self.tail = copied(self.start[:-1], memory), copied(self.start[:-1], memory)
        self.at, self.same = scratch(int(self.start[-1]), np.int32, memory), scratch(int(self.start[-1]), np.uint16, memory)
        self.since = scratch(len(counts), np.uint16, memory)

    def feed(self, symbols: np.ndarray, suffixes: np.ndarray, of: np.ndarray, same: np.ndarray) -> None:
        """Queue suffixes induced from the sources `of` (their indices, rising) among all sources with common prefixes `same`."""
        if not len(same):
            return
        if not len(of):
            np.minimum(self.since, same.min(), out=self.since)
            return
        order, first, to = places(symbols, self.tail)
        heads, of = symbols[order[first]], of[order]
        # The sources after the last of the same symbol: for the first of a symbol those of former blocks too.
        left = np.empty(len(of), np.int64)
        left[1:] = of[:-1] + 1
        left[first] = 0
        least = range_minimum(same, left, of + 1)
        least[first] = np.minimum(self.since[heads], least[first])
        new = np.where(least >= EQUAL, np.minimum(least, MOST - 1) + 1, np.minimum(least + 1, EQUAL - 1))
        new[first[to[first] == self.start[heads]]] = 0  # the first of a queue has nothing before it
        self.at[to], self.same[to] = suffixes[order], new
        rest = np.full(len(same) + 1, MOST)
        np.minimum.accumulate(same[::-1], out=rest[-2::-1])
        last = np.empty(len(first), np.int64)
        last[:-1], last[-1] = first[1:] - 1, len(of) - 1
        np.minimum(self.since, rest[0], out=self.since)
        self.since[heads] = rest[of[last] + 1]

    def take(self, symbol: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        a = self.head[symbol]
        b = min(self.tail[symbol], a + most)
        self.head[symbol] = b
        return np.array(self.at[a:b]), np.array(self.same[a:b])


def scan(text: np.ndarray, symbols: int, memory: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many large and small suffixes each symbol begins, and the places of the leftmost small ones; from right to left."""
    n = len(text)
    large, small_ = scratch(symbols, np.int64, memory), scratch(symbols, np.int64, memory)
    stars, free = scratch(n // 2 + 1, np.int32, memory), n // 2 + 1
    small_[text[n - 1]] += 1
    end, kind = n - 1, True
    while end > 0:
        a = max(0, end - block)
        x = np.array(text[a : end + 1])
        small, other = np.empty(len(x), bool), x[:-1] != x[1:]
        small[:-1], small[-1] = x[:-1] < x[1:], kind
        decides = np.where(np.append(other, True), np.arange(len(x)), len(x))
        small = small[np.minimum.accumulate(decides[::-1])[::-1]]  # an equal run is of the type of its last
        star = np.flatnonzero(small[1:] & ~small[:-1]) + a + 1
        stars[free - len(star) : free] = star
        free -= len(star)
        tally(small_, x[:-1][small[:-1]])
        tally(large, x[:-1][~small[:-1]])
        end, kind = a, bool(small[0])
    return large, small_, stars[free:]


def induce(text: np.ndarray, counts: tuple[np.ndarray, np.ndarray], seeds: tuple[np.ndarray, np.ndarray], seam: Callable[[np.ndarray, np.ndarray], np.ndarray], memory: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """All suffixes in descending order with what each has in common with the one before, and which are leftmost small ones.

    seeds: the leftmost small suffixes in ascending order, and what each has in common with the one before.
    seam: what large and small suffixes of one first symbol have in common.
    """
    symbols = len(counts[0])
    stars = scratch(symbols, np.int64, memory)
    for a, b in blocks(0, len(seeds[0]), block):
        tally(stars, text[seeds[0][a:b]])
    begin = begins(stars, memory)

    def follow(queues: Queues, at: np.ndarray, same: np.ndarray, takes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Induce from a block of sources of one symbol; the symbols before them."""
        before = text[at - 1]
        of = np.flatnonzero(takes(before) & (at > 0))
        queues.feed(before[of], at[of] - 1, of, same)
        return before

    # Symbols with few suffixes are taken several at a time, as far as none of them induces into another of them.
    large, c, width = Queues(counts[0], memory), 0, LEAST
    while c < symbols:
        e = min(symbols, c + width)
        queued, own = large.tail[c:e] - large.head[c:e], stars[c:e]
        ends = np.cumsum(queued + own)
        if ends[-1] > block:
            e = c + max(1, int(np.searchsorted(ends, block, "right")))
            queued, own, ends = queued[: e - c], own[: e - c], ends[: e - c]
        cut = c
        if e - c > 1:
            x = np.repeat(np.arange(c, e), queued + own)
            at, same = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.uint16)
            seeded = ramp(queued + own) >= np.repeat(queued, queued + own)
            index = np.repeat(large.head[c:e], queued) + ramp(queued)
            at[~seeded], same[~seeded] = large.at[index], large.same[index]
            at[seeded], same[seeded] = seeds[0][begin[c] : begin[e]], seeds[1][begin[c] : begin[e]]
            before = text[at - 1]
            takes = (at > 0) & (before >= x + seeded)
            cut = min(e, int(before[takes].min(initial=e)))
        if cut > c:
            k = int(ends[cut - c - 1])
            at, same, before, takes = at[:k], same[:k], before[:k], takes[:k]
            first = (ends - own)[: cut - c][own[: cut - c] > 0]
            large.head[c:cut] = large.tail[c:cut]
            same[first] = 0
            both = first[queued[: cut - c][own[: cut - c] > 0] > 0]
            if len(both):
                same[both] = seam(at[both - 1], at[both])
            of = np.flatnonzero(takes)
            large.feed(before[of], at[of] - 1, of, same)
            width = 2 * width if cut == e else max(LEAST, 2 * (cut - c))
            c = cut
            continue
        while large.head[c] < large.tail[c]:
            at, same = large.take(c, block)
            follow(large, at, same, lambda x, c=c: x >= c)
        for a, b in blocks(begin[c], begin[c + 1], block):
            at, same = np.array(seeds[0][a:b]), np.array(seeds[1][a:b])
            if a == begin[c]:
                same[0] = seam(large.at[large.start[c + 1] - 1 : large.start[c + 1]], at[:1])[0] if counts[0][c] else 0
            follow(large, at, same, lambda x, c=c: x > c)
        c += 1
    small, c, width = Queues(counts[1], memory), symbols - 1, LEAST
    while c > 0:
        e = max(1, c + 1 - width)
        queued, own = (small.tail[e : c + 1] - small.head[e : c + 1])[::-1], counts[0][e : c + 1][::-1]
        ends = np.cumsum(queued + own)
        if ends[-1] > block:
            e = c + 1 - max(1, int(np.searchsorted(ends, block, "right")))
            queued, own, ends = queued[: c + 1 - e], own[: c + 1 - e], ends[: c + 1 - e]
        cut = c
        if c + 1 - e > 1:
            x = np.repeat(np.arange(c, e - 1, -1), queued + own)
            at, same = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.uint16)
            was_large = ramp(queued + own) >= np.repeat(queued, queued + own)
            index = np.repeat(small.head[e : c + 1][::-1], queued) + ramp(queued)
            at[~was_large], same[~was_large] = small.at[index], small.same[index]
            index = np.repeat(large.start[e + 1 : c + 2][::-1] - 1, own) - ramp(own)
            at[was_large], same[was_large] = large.at[index], large.same[np.minimum(index + 1, len(large.same) - 1)]
            before = text[at - 1]
            takes = (at > 0) & (before <= x - was_large)
            cut = max(e - 1, int(before[takes].max(initial=e - 1)))
        if cut < c:
            k = int(ends[c - cut - 1])
            at, same, before, takes, x, was_large = at[:k], same[:k], before[:k], takes[:k], x[:k], was_large[:k]
            first = (ends - own)[: c - cut][own[: c - cut] > 0]
            small.head[cut + 1 : c + 1] = small.tail[cut + 1 : c + 1]
            same[first] = 0
            both = first[queued[: c - cut][own[: c - cut] > 0] > 0]
            if len(both):
                same[both] = seam(at[both], at[both - 1])
            of = np.flatnonzero(takes)
            small.feed(before[of], at[of] - 1, of, same)
            if len(at):
                yield at, same, ~was_large & (before > x) & (at > 0)
            width = 2 * width if cut == e - 1 else max(LEAST, 2 * (c - cut))
            c = cut
            continue
        last = np.zeros(0, np.int32)
        while small.head[c] < small.tail[c]:
            at, same = small.take(c, block)
            last = at[-1:]
            before = follow(small, at, same, lambda x, c=c: x <= c)
            yield at, same, (before > c) & (at > 0)
        top = large.start[c + 1]
        for b in range(top, large.start[c], -block):
            a = max(large.start[c], b - block)
            at, same = np.array(large.at[a:b][::-1]), np.array(large.same[a + 1 : b + 1][::-1])
            if b == top:
                first = seam(at[:1], last)[0] if len(last) else 0
                same = np.append(np.uint16(first), same[len(same) - len(at) + 1 :])
            follow(small, at, same, lambda x, c=c: x < c)
            yield at, same, None
        c -= 1
    yield np.array([len(text) - 1], np.int32), np.zeros(1, np.uint16), np.ones(1, bool)  # the last symbol is the only smallest


def thinned(stream: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> Stream:
    """Of a stream, the marked tuples, with what they have in common with the marked one before."""
    low = MOST
    for at, same, marked in stream:
        k = np.flatnonzero(marked) if marked is not None else ()
        if not len(k):
            low = min(low, same.min())
            continue
        least = np.minimum.reduceat(same[: k[-1] + 1], np.concatenate([[0], k[:-1] + 1]))
        least[0] = min(least[0], low)
        low = same[k[-1] + 1 :].min() if k[-1] + 1 < len(same) else MOST
        yield at[k], least


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """What the suffixes at a and b have in common, `most` at most, of which the first `known` symbols are."""
    out, n = np.minimum(known, most).astype(np.int64), len(text)
    open_ = np.flatnonzero(out < most)
    while len(open_):
        i, j = a[open_] + out[open_], b[open_] + out[open_]
        inside = (i < n) & (j < n)
        open_ = open_[inside & (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)])]
        out[open_] += 1
        open_ = open_[out[open_] < most]
    return out


def named(text: np.ndarray, stars: np.ndarray, stream: Stream, memory: int, block: int) -> tuple[np.ndarray, int]:
    """The name of each leftmost small suffix's substring in the order of the text, and how many names there are."""
    names, found = scratch(len(stars), np.int32, memory), 0
    for at, same in stream:
        new = found + np.cumsum(same < EQUAL)
        names[np.searchsorted(stars, at)] = new
        found = int(new[-1])
    for a, b in blocks(0, len(stars), block):
        names[a:b] = found - names[a:b]
    return names, found


def seeds_of(text: np.ndarray, stars: np.ndarray, names: np.ndarray, count: int, most: int, memory: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The leftmost small suffixes in ascending order, with their common prefixes."""
    m = len(stars)
    order, same = scratch(m, np.int32, memory), scratch(m, np.uint16, memory)

    def by_name() -> Stream:
        counts = scratch(count, np.int64, memory)
        for a, b in blocks(0, m, block):
            tally(counts, names[a:b])
        tail, where = begins(counts, memory), scratch(m, np.int32, memory)
        for a, b in blocks(0, m, block):
            own, _, to = places(names[a:b], tail)
            where[to] = np.arange(a, b)[own]
        before = -1
        for b in range(m, 0, -block):
            own = np.array(where[max(0, b - block) : b][::-1])
            name = names[own]
            yield own, np.where(name == np.append(before, name[:-1]), most, 0)
            before = name[-1]

    def by_recursion() -> Stream:
        inner = scratch(m + 1, np.uint16 if count < 0xFFFF else np.int32, memory)
        for a, b in blocks(0, m, block):
            inner[a:b] = names[a:b] + 1
        return thinned((at, k, at < m) for at, k in suffixes(inner, count + 1, most // 2 + 1, memory, block))

    # A substring is at least three symbols long, and each stands for two of the text at least.
    free, before = m, -1
    for own, k in by_name() if count == m or most <= 3 else by_recursion():
        place = np.array(stars[own], np.int64)
        a, b = free - len(own), free
        order[a:b] = place[::-1]
        prior = np.append(own[0] if before < 0 else before, own[:-1]).astype(np.int64)
        more = np.minimum(k, m - 1 - np.maximum(own, prior))  # both have k names more
        known = np.where(k >= most, most, stars[own + more].astype(np.int64) - place)
        with_prior = common(text, place, stars[prior].astype(np.int64), known, most)
        # What two neighbours have in common stands at the larger one, which came first here.
        same[a + 1 : b] = with_prior[1:][::-1]
        if before >= 0:
            same[b] = with_prior[0]
        free, before = a, own[-1]
    return order, same


def suffixes(text: np.ndarray, symbols: int, most: int, memory: int = MEMORY, block: int = BLOCK) -> Stream:
    """All suffixes of a text in descending order, in blocks, with what each has in common with the one before.

    The text's last symbol is its only smallest, 0, and it is at most 2**31 symbols long. Common prefixes are exact
    below `most` and at least `most` else.
    """
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.uint16)
        return
    large, small, stars = scan(text, symbols, memory, block)
    # By their first symbol alone the leftmost small suffixes are equal; the induction sorts their substrings.
    firsts = scratch(symbols, np.int64, memory)
    for a, b in blocks(0, len(stars), block):
        tally(firsts, text[stars[a:b]])
    tail, order = begins(firsts, memory), scratch(len(stars), np.int32, memory)
    for a, b in blocks(0, len(stars), block):
        own, _, to = places(text[stars[a:b]], tail)
        order[to] = stars[a:b][own]
    equal = np.broadcast_to(EQUAL, len(stars))
    names, count = named(text, stars, thinned(induce(text, (large, small), (order, equal), lambda a, b: np.zeros(len(a), np.uint16), memory, block)), memory, block)
    del order
    seeds = seeds_of(text, stars, names, count, most, memory, block)
    del names, stars

    def seam(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common(text, a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int64), most)

    for at, same, _ in induce(text, (large, small), seeds, seam, memory, block):
        yield at, same
