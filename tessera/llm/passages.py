"""Suffix-array dedup: bytes that an earlier document has in a string of MATCH bytes are removed.

Each window of MATCH bytes has an anchor, its smallest hashed GRAM-byte string, so equal windows share an anchor and
can be compared in that anchor's shard alone. Texts are dealt to partitions once. A partition tells each bucket of
anchors which ones it has; what another document has too is told back. The segments of these (all windows of an
anchor, 50 to 76 bytes) go to the anchor's shard, equal ones of a partition once and with their smallest document
only. A shard sorts its segments by external induction (induced.py): suffixes that have MATCH bytes in common are one
string, and its smallest document keeps it. The shard's answers go back by segment, and each partition applies them.

Hot keys: whatever the number of documents behind an anchor or a segment, a partition sends it once; an anchor with
more than CROWD different segments sends its windows one by one, dealt by their own hashes. Rows between partitions
pack what one has for another, so there are never more of them than of anchors. Segments are told apart by 64-bit hashes.

Defined cases: a null or empty text has no bytes; texts shorter than MATCH lose nothing; matches never cross
documents; rows with one id are one document's copies and do not take from each other; a null id counts as the
smallest; very long texts are read whole; an empty table gives an empty result; only the id (an integer) and text
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, parts, powers, prefix_hashes, slices, span_hashes, utf8
from tessera.llm.induced import BLOCK, MEMORY, blocks, scratch, suffixes

MATCH, GRAM = 50, 24
#: Bytes that are hashed at once (small arrays stay in the processor's cache), the longest part of a text, and the bits of a place.
SLICE, PART, PLACE = 1 << 18, 1 << 23, np.uint64((1 << 24) - 1)
#: Bytes of segments that are gathered before they are sent, and segments of an anchor beyond which its windows are sent.
HELD, CROWD = 32 << 20, 60_000
NO_ID = -(1 << 63)
SEVERAL = 0x80


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each anchor's hash, place, first and last window start, and text.

    A window's anchor is the leftmost of its smallest hashes: hash and place are packed in one number, so that a running
    minimum gives both. A longer text than PART is taken in parts that overlap by a window.
    """
    if len(data) > PART + MATCH:
        found = []
        for i in range(0, len(data) - MATCH + 1, PART):
            part = data[i : i + PART + MATCH - 1]
            h, spot, lo, hi, doc = anchors(part, np.clip(offsets - i, 0, len(part)))
            found.append((h, spot + i, lo + i, hi + i, doc))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    width, n = MATCH - GRAM + 1, len(data)
    sizes = np.diff(offsets)
    if n < MATCH or sizes.max() < MATCH:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    sums = prefix_hashes(data)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n)[1][: n - GRAM + 1])
    best, have = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        best, have = np.minimum(best[:-step], best[step:]), have + step
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(best)]
    start = np.flatnonzero(np.arange(MATCH, len(best) + MATCH) <= np.repeat(offsets[1:], sizes)[: len(best)])
    own, doc = (best[start] & PLACE).astype(np.int64), text[start]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(own)) - 1
    return h[own[first]], own[first], start[first], start[last], doc[first].astype(np.int64)


def named(hashes: np.ndarray, n: int) -> np.ndarray:
    """Keys of anchors: their bucket among n, and 32 more bits."""
    return (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(n) << np.uint64(32) | hashes >> np.uint64(32)


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64)


def _ids(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.compute.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def _read(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", kind) for x in column]


def _flat(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(*names: str, binary: tuple[str, ...] = ()) -> pa.Schema:
    return pa.schema([*((n, pa.int32()) for n in names), *((n, pa.binary()) for n in binary)])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


#: An anchor's key, and how many different segments it has in the partition; 0x8000 says that more than one row has it.
ASKED = _schema("bucket", "target", binary=("keys", "counts"))
#: What is told back to a partition, of anchors (shared, hot) and of segments: those that go whole, and those of which the smallest document keeps all but runs.
TOLD = _schema("target", binary=("shared", "hot", "whole", "keys", "lows", "runs", "starts", "lengths"))
SEGMENTS = _schema("shard", "target", binary=("body", "sizes", "spots", "lows"))


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of key and its indices, in order."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    for i, j in zip(first, np.append(first[1:], len(key)), strict=True):
        yield int(key[order[i]]), order[i:j]


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _among(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x would stand in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def asked_anchors(dealt: DataFrame, n: int) -> DataFrame:
    """For each bucket: the anchors of each partition."""

    def ask(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, found, row = key[0].as_py(), [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            for i, j in slices(offsets, SLICE):
                some, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, _, lo, hi, doc = anchors(some, at)
                if len(h):
                    _, first = np.unique(span_hashes(prefix_hashes(some), lo, hi + MATCH), return_index=True)
                    new = np.zeros(len(h), np.uint16)
                    new[first] = 1
                    keys = named(h, n)
                    order = np.argsort(keys, kind="stable")
                    keys, rows = keys[order], doc[order]
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    last = np.append(first[1:], len(keys)) - 1
                    found.append((keys[first], np.add.reduceat(new[order].astype(np.int32), first), row + i + rows[first], row + i + rows[last]))
            row += len(offsets) - 1
        if not found:
            return
        keys, count, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        several = low[order][first] != high[order][np.append(first[1:], len(keys)) - 1]
        count = np.minimum(np.add.reduceat(count[order], first), 0x7FFF) | np.where(several, 0x8000, 0)
        keys = keys[first]
        yield _rows([(b, target, keys[i].astype("<u4").tobytes(), count[i].astype("<u2").tobytes()) for b, i in _by(bucket(keys))], ASKED)

    return dealt.groupBy("target").applyInArrow(ask, _ddl(ASKED))


def shared_anchors(asked: DataFrame, crowd: int) -> DataFrame:
    """For each partition: its anchors that more than one row has, and those of them with too many segments for a shard."""

    def share(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, targets, counts = [], [], []
        for batch in batches:
            got = _read(batch.column("keys"), "<u4")
            own += got
            targets += [np.full(len(x), t, np.int32) for x, t in zip(got, batch.column("target").to_pylist(), strict=True)]
            counts += _read(batch.column("counts"), "<u2")
        keys, target, count = _flat(own, "<u4"), _flat(targets, np.int32), _flat(counts, "<u2")
        order = np.argsort(keys, kind="stable")
        keys, target, count = keys[order], target[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.append(first, len(keys)))
        keep = np.repeat((times > 1) | (count[first] >= 0x8000), times)
        hot = np.repeat(np.add.reduceat(count & 0x7FFF, first) > crowd, times)[keep]
        whole, target = np.uint64(key[0].as_py()) << np.uint64(32) | keys[keep].astype(np.uint64), target[keep]
        yield _rows([(t, whole[i[~hot[i]]].tobytes(), whole[i[hot[i]]].tobytes(), *[None] * 6) for t, i in _by(target)], TOLD)

    return asked.groupBy("bucket").applyInArrow(share, _ddl(TOLD))


def segments_of(some: np.ndarray, at: np.ndarray, n: int, hot: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Key of the anchor, hash, start, size, text and the anchor's place of each segment (if shared: of these and the hot ones alone); hot anchors' windows one by one."""
    h, spot, lo, hi, doc = anchors(some, at)
    keys = named(h, n)
    if shared is not None and len(keys):
        keep = _among(shared, keys)[1] | _among(hot, keys)[1]
        keys, spot, lo, hi, doc = keys[keep], spot[keep], lo[keep], hi[keep], doc[keep]
    if len(hot) and len(keys):
        times = np.where(_among(hot, keys)[1], hi + 1 - lo, 1)
        step = _ramp(times)
        single = np.repeat(times > 1, times) | np.repeat(_among(hot, keys)[1], times)
        keys, spot, lo, hi, doc = np.repeat(keys, times), np.repeat(spot, times), np.repeat(lo, times) + step, np.repeat(hi, times), np.repeat(doc, times)
        hi[single] = lo[single]
    body = span_hashes(prefix_hashes(some), lo, hi + MATCH)
    if len(hot) and len(keys):
        keys = np.where(single, named(body, n), keys)
    return keys, body, lo, hi + MATCH - lo, doc, spot - lo


def _heard(told: pa.Table, column: str) -> np.ndarray:
    return np.sort(_flat(_read(told[column], "<u8"), np.uint64))


def segments(told: DataFrame, dealt: DataFrame, n: int) -> DataFrame:
    """Segments of shared anchors by shard: different ones of a partition, with their smallest document."""

    def cut_out(told: pa.Table, rows: pa.Table) -> pa.Table:
        shared, hot, target = _heard(told, "shared"), _heard(told, "hot"), 0
        out: list[tuple] = []
        held: list[tuple] = []

        def send() -> None:
            keys, body, size, spot, low, high = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            flat = np.concatenate([x[0] for x in held])
            held.clear()
            order = np.argsort(body, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], body[order][1:] != body[order][:-1]]))
            low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
            start, one = np.cumsum(size) - size, order[first]
            mark = size[one] | np.where(low < high, SEVERAL, 0)
            for s, i in _by(bucket(keys[one])):
                k = one[i]
                out.append((s, target, _take(flat, start[k], size[k]).tobytes(), mark[i].astype(np.uint8).tobytes(), spot[k].astype(np.uint8).tobytes(), low[i].tobytes()))

        if told.num_rows and rows.num_rows:
            target = rows["target"][0].as_py()
            for part in rows.to_batches(max_chunksize=2000):
                ids = _ids(part.column("doc_id"))
                data, offsets = utf8(part.column("text"))
                for i, j in slices(offsets, SLICE):
                    some = data[offsets[i] : offsets[j]]
                    keys, body, lo, size, doc, spot = segments_of(some, offsets[i : j + 1] - offsets[i], n, hot, shared)
                    if not len(keys):
                        continue
                    own, order = ids[i + doc], np.argsort(body, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], body[order][1:] != body[order][:-1]]))
                    one = order[first]
                    held.append((_take(some, lo[one], size[one]), keys[one], body[one], size[one], spot[one], np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first)))
                    if sum(len(x[0]) for x in held) >= HELD:
                        send()
            if held:
                send()
        return pa.Table.from_batches([_rows(out, SEGMENTS)])

    return told.groupBy("target").cogroup(dealt.groupBy("target")).applyInArrow(cut_out, _ddl(SEGMENTS))


def may_meet(body: np.ndarray, size: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Which of different segments can have a window that another has too.

    A window is its anchor and MATCH - GRAM bytes around it: two thirds of these to the left, two thirds to the right, or
    a third to either side. So one of these longer strings must be in another segment.
    """
    third = -(-(MATCH - GRAM) // 3)
    around = ((MATCH - GRAM - third + 1, 0), (third, third), (0, MATCH - GRAM - third + 1))
    start, keys = np.cumsum(size) - size, np.zeros((3, len(size)), np.uint64)
    for a, b in blocks(0, len(size), 1 << 14):
        at, base = start[a:b] + spot[a:b], start[a]
        sums = prefix_hashes(np.array(body[base : start[b - 1] + size[b - 1]]))
        for k, (left, right) in enumerate(around):
            lo, hi = at - left, at + GRAM + right
            own = np.flatnonzero((lo >= start[a:b]) & (hi <= start[a:b] + size[a:b]))
            keys[k, a + own] = span_hashes(sums, lo[own] - base, hi[own] - base)
    out = np.zeros(len(size), bool)
    for key in keys:
        order = np.argsort(key, kind="stable")
        same = (key[order][1:] == key[order][:-1]) & (key[order][1:] > 0)
        out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def smaller_elsewhere(body: np.ndarray, size: np.ndarray, spot: np.ndarray, low: np.ndarray, memory: int = MEMORY, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different segments laid end to end: segment, first and last window start of each run of windows that a segment
    of a smaller document has too. Segments that can have no window in common with another are left out of the sort."""
    some = np.flatnonzero(may_meet(body, size, spot))
    if not len(some):
        return (np.zeros(0, np.int64),) * 3
    start = np.cumsum(size) - size
    to = np.concatenate([[0], np.cumsum(size[some] + 1)])
    # Symbols: 0 ends the text, 1 each segment, then bytes.
    text = scratch(int(to[-1]) + 1, np.uint16, memory)
    for a, b in blocks(0, len(some), max(1, block // 64)):
        own, long_ = np.ones(to[b] - to[a], np.uint16), size[some[a:b]]
        own[np.repeat(to[a:b] - to[a], long_) + _ramp(long_)] = _take(body, start[some[a:b]], long_).astype(np.uint16) + 2
        text[to[a] : to[b]] = own
    gone: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def close(at: np.ndarray, group: np.ndarray) -> None:
        """Whole groups of suffixes that have MATCH bytes in common: windows of segments whose document is not the least."""
        of = np.searchsorted(to, at, "right") - 1
        window = at + MATCH < to[of + 1]
        at, of, group = at[window], of[window], group[window]
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            own = low[some[of]]
            least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(at))))
            gone.append(at[own > least])

    for at, same in suffixes(text, 258, MATCH, memory, block):
        # What has no MATCH bytes in common with a neighbour is a group of its own; the last group may go on.
        new = np.flatnonzero(same < MATCH)
        if held and not len(new):
            held.append(at)
            continue
        if held:
            whole = np.concatenate([*held, at[: new[0]]]).astype(np.int64)
            if len(whole) > 1:
                close(whole, np.zeros(len(whole), np.int8))
        last = int(new[-1])
        group = np.cumsum(same[:last] < MATCH)
        times = np.bincount(group, minlength=1)
        several = (times[group] > 1) & (np.arange(last) >= new[0])
        if several.any():
            close(at[:last][several].astype(np.int64), group[several])
        held = [at[last:]]
    whole = np.concatenate(held).astype(np.int64)
    if len(whole) > 1:
        close(whole, np.zeros(len(whole), np.int8))
    at = np.sort(np.concatenate(gone)) if gone else np.zeros(0, np.int64)
    of = np.searchsorted(to, at, "right") - 1
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return some[of[first]], at[first] - to[of[first]], at[last] - to[of[first]]


def decided(found: DataFrame) -> DataFrame:
    """For each partition: what of its segments goes."""

    def decide(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, sizes, spots, lows, targets = [], [], [], [], []
        for batch in batches:
            body += _read(batch.column("body"), np.uint8)
            sizes += (got := _read(batch.column("sizes"), np.uint8))
            spots += _read(batch.column("spots"), np.uint8)
            lows += _read(batch.column("lows"), np.int64)
            targets += [np.full(len(x), t, np.int32) for x, t in zip(got, batch.column("target").to_pylist(), strict=True)]
        mark, spot, low, target = np.concatenate(sizes), np.concatenate(spots).astype(np.int64), np.concatenate(lows), np.concatenate(targets)
        several, size = mark >= SEVERAL, (mark & (SEVERAL - 1)).astype(np.int64)
        flat = scratch(int(size.sum()), np.uint8)
        at, hashes = 0, []
        while body:
            own = body.pop(0)
            flat[at : at + len(own)] = own
            at += len(own)
        start = np.cumsum(size) - size
        for a, b in blocks(0, len(size), 1 << 14):
            part = np.array(flat[start[a] : start[b - 1] + size[b - 1]])
            hashes.append(span_hashes(prefix_hashes(part), start[a:b] - start[a], start[a:b] - start[a] + size[a:b]))
        keys = np.concatenate(hashes)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        times = np.diff(np.append(first, len(keys)))
        least, one = np.minimum.reduceat(low[order], first), order[first]
        kind = np.empty(len(keys), np.int64)
        kind[order] = np.repeat(np.arange(len(first)), times)
        picked = scratch(int(size[one].sum()), np.uint8)
        to = np.cumsum(size[one]) - size[one]
        for a, b in blocks(0, len(one), 1 << 14):
            picked[to[a] : to[b - 1] + size[one[b - 1]]] = _take(flat, start[one[a:b]], size[one[a:b]])
        del flat
        of, begin, end = smaller_elsewhere(picked, size[one], spot[one], least)
        runs = np.bincount(of, minlength=len(one))
        run_at = np.cumsum(runs) - runs
        # Once for each segment and partition, which may have sent it in several lots.
        order = np.lexsort((target, kind))
        first = np.flatnonzero(np.concatenate([[True], (kind[order][1:] != kind[order][:-1]) | (target[order][1:] != target[order][:-1])]))
        several = np.logical_or.reduceat(several[order], first) | (np.diff(np.append(first, len(order))) > 1)
        low, one = np.minimum.reduceat(low[order], first), order[first]
        kind, target, keys = kind[one], target[one], keys[one]
        # A partition whose smallest document is not the segment's loses it whole; the other needs telling if it has more documents, or runs.
        whole = low > least[kind]
        told = whole | several | (runs[kind] > 0)
        out = []
        for t, i in _by(np.where(told, target, -1)):
            if t >= 0:
                w, k = i[whole[i]], i[~whole[i]]
                pick = np.repeat(run_at[kind[k]], runs[kind[k]]) + _ramp(runs[kind[k]])
                out.append((t, None, None, keys[w].tobytes(), keys[k].tobytes(), low[k].tobytes(), runs[kind[k]].astype(np.uint8).tobytes(), begin[pick].astype(np.uint8).tobytes(), (end[pick] - begin[pick] + MATCH).astype(np.uint8).tobytes()))
        if out:
            yield _rows(out, TOLD)

    return found.groupBy("shard").applyInArrow(decide, _ddl(TOLD))


def spans_of(told: pa.Table, some: np.ndarray, at: np.ndarray, ids: np.ndarray, n: int, hot: np.ndarray, heard: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end (in `some`) of everything that goes, by what was heard of segments."""
    whole, keys, lows, runs, run_at, starts, lengths = heard
    _, body, lo, size, doc, _ = segments_of(some, at, n, hot)
    where, kept = _among(keys, body)
    gone = _among(whole, body)[1] | (kept & (ids[doc] > lows[where] if len(lows) else False))
    firsts = np.flatnonzero(kept & ~gone)
    times = runs[where[firsts]] if len(runs) else np.zeros(0, np.int64)
    pick, again = np.repeat(run_at[where[firsts]], times) + _ramp(times) if len(firsts) else np.zeros(0, np.int64), np.repeat(firsts, times)
    begin = np.concatenate([lo[gone], lo[again] + starts[pick]])
    return np.concatenate([doc[gone], doc[again]]), begin, begin + np.concatenate([size[gone], lengths[pick]])


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    n = parts(docs)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # Equal rows alone are sure to meet: what repeats one id is spread too.
    dealt = docs.withColumn("target", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "target")
    shared = shared_anchors(asked_anchors(dealt, n), crowd)
    told = decided(segments(shared, dealt, n)).unionByName(shared.where("length(hot) > 0"))

    def apply(told: pa.Table, rows: pa.Table) -> pa.Table:
        hot, whole = _heard(told, "hot"), _heard(told, "whole")
        keys, lows, runs = _flat(_read(told["keys"], "<u8"), np.uint64), _flat(_read(told["lows"], np.int64), np.int64), _flat(_read(told["runs"], np.uint8), np.uint8).astype(np.int64)
        starts, lengths = (_flat(_read(told[c], np.uint8), np.uint8).astype(np.int64) for c in ("starts", "lengths"))
        order, run_at = np.argsort(keys, kind="stable"), np.cumsum(runs) - runs
        heard = (whole, keys[order], lows[order], runs[order], run_at[order], starts, lengths)
        out = []
        for part in rows.to_batches(max_chunksize=2000):
            ids, names = _ids(part.column("doc_id")), part.column("doc_id").to_pylist()
            data, offsets = utf8(part.column("text"))
            for i, j in slices(offsets, SLICE):
                some, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                doc, begin, end = spans_of(told, some, at, ids[i:j], n, hot, heard) if told.num_rows else (np.zeros(0, np.int64),) * 3
                order = np.lexsort((begin, doc))
                doc, begin, end = doc[order], begin[order], end[order]
                first = np.searchsorted(doc, np.arange(j - i + 1))
                raw = some.tobytes()
                for d in range(j - i):
                    lo, hi = begin[first[d] : first[d + 1]], end[first[d] : first[d + 1]]
                    removed = spans_ = 0
                    kept = raw[at[d] : at[d + 1]]
                    if len(lo):
                        reach = np.maximum.accumulate(hi)
                        new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
                        left, right = lo[new], np.append(reach[new[1:] - 1], reach[-1])
                        removed, spans_ = int((right - left).sum()), len(new)
                        kept = b"".join(raw[x:y] for x, y in zip([int(at[d]), *right.tolist()], [*left.tolist(), int(at[d + 1])], strict=True))
                    out.append((names[i + d], int(at[d + 1] - at[d]), removed, spans_, hashlib.sha256(kept).hexdigest(), kept))
        return pa.Table.from_batches([_rows(out, RESULT)])

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return told.groupBy("target").cogroup(dealt.groupBy("target")).applyInArrow(apply, result)
