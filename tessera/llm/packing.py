"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Defined cases: a null or empty text is one piece of the single end id; a very long text is encoded whole and cut into
whole sequences behind a shorter first piece; equal lengths are told apart by document and piece; repeated rows are
packed as documents of their own; an empty table gives an empty result; only the id and text columns are read,
whatever else the table has.
"""

from __future__ import annotations


import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import cut

LENGTH, END, GROUP = 2048, 0, 8192


def tokenizer_file() -> str:
    """The vocabulary of byte_bpe_50k.json as ranks; both give the same ids (tests hold them against each other)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that the JSON form beside the ranks adds to them; it reads them in a text as one id each."""
    whole = Path(path).with_suffix(".json")
    return {t["content"]: t["id"] for t in json.loads(whole.read_text())["added_tokens"]} if whole.exists() else {}


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Whole sequences, behind a shorter first piece if n is no multiple."""
    return [n % length] * (n % length > 0) + [length] * (n // length)


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (tells repeated rows apart), piece, start, length, ids_crc32: one scan; ids stay in the task."""
    path = tokenizer or tokenizer_file()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            who, out = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode.encode_to_numpy(text.as_py() or "", allowed_special="all"), END).astype("<u4")
                at = 0
                for k, n in enumerate(piece_lengths(len(ids), length)):
                    who.append(i)
                    out.append((k, at, n, zlib.crc32(ids[at : at + n])))
                    at += n
            columns = [pa.array(c) for c in (zip(*out, strict=True) if out else ([],) * 4)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *[c.cast(t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin that takes it."""
    where = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, bool)
    count = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        free = size + int(open_rooms[size:].argmax())
        if open_rooms[free]:
            bin_ = room[free].pop()
            open_rooms[free] = bool(room[free])
        else:
            free, bin_, count = capacity, count, count + 1
        where[i] = bin_
        room[free - size].append(bin_)
        open_rooms[free - size] = free > size or open_rooms[0]
        if free == size:
            open_rooms[0] = bool(room[0])
    return where


def local_search(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Exchange documents between underfull bins while the sum of squared fills grows; bins that empty go.

    The emptiest bin that can still change gives documents away: one into another bin's room, one for a smaller one,
    one for two smaller ones, or two for one that is less than both. Each step moves fill to a fuller bin, so the sum
    grows and the search ends; it also ends when no packing can have fewer bins.
    """
    where = where.copy()
    fill = np.bincount(where, sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    live, stuck = int((fill > 0).sum()), np.zeros(len(fill), bool)
    # Items of full bins take no part: nothing can be gained from them.
    while live > least:
        free = (fill > 0) & ~stuck & (fill < capacity)
        if not free.any():
            break
        victim = int(np.flatnonzero(free)[fill[free].argmin()])
        moved = False
        for a in np.flatnonzero(where == victim)[np.argsort(-sizes[where == victim], kind="stable")]:
            if where[a] != victim:  # it has gone with another
                continue
            size, slack = int(sizes[a]), capacity - fill
            slack[(fill < fill[victim]) | (fill == 0)] = -1  # only to bins at least as full
            slack[victim] = -1
            fits = np.flatnonzero(slack >= size)
            if len(fits):
                to = int(fits[slack[fits].argmin()])
                where[a], moved = to, True
                fill[victim] -= size
                fill[to] += size
                continue
            room = slack[where]
            swaps = np.flatnonzero((room > 0) & (sizes < size) & (sizes + room >= size))
            if len(swaps):
                b = int(swaps[sizes[swaps].argmin()])  # the largest gain
                to, gain = int(where[b]), size - int(sizes[b])
                where[a], where[b], moved = to, victim, True
                fill[victim] -= gain
                fill[to] += gain
                continue
            pair = _two(sizes, where, slack, size)
            if pair is not None:
                b, c, to = pair
                gain = size - int(sizes[b]) - int(sizes[c])
                where[a], where[b], where[c], moved = to, victim, victim, True
                fill[victim] -= gain
                fill[to] += gain
                continue
            mate = np.flatnonzero((where == victim) & (np.arange(len(where)) != a))
            found = _one(sizes, where, slack, size, sizes[mate]) if len(mate) else None
            if found is not None:
                b, c, to = found
                gain = size + int(sizes[mate[c]]) - int(sizes[b])
                where[a], where[mate[c]], where[b], moved = to, to, victim, True
                fill[victim] -= gain
                fill[to] += gain
        if fill[victim] == 0:
            live -= 1
            stuck[:] = False
        elif not moved:
            stuck[victim] = True
    return np.unique(where, return_inverse=True)[1]


def _two(sizes: np.ndarray, where: np.ndarray, slack: np.ndarray, size: int) -> tuple[int, int, int] | None:
    """The two smallest documents of one bin together, below `size`, whose places it fits in: each with its least partner."""
    item = np.flatnonzero((slack[where] > 0) & (sizes < size))
    if len(item) < 2:
        return None
    item = item[np.lexsort((sizes[item], where[item]))]
    own, bin_, span = sizes[item], where[item], size + 1
    line = bin_ * span + own
    need = np.maximum(size - slack[bin_] - own, 0)
    at = np.searchsorted(line, bin_ * span + need)
    at += at == np.arange(len(item))  # no document is its own partner
    other = np.minimum(at, len(item) - 1)
    both = own + own[other]
    fit = np.flatnonzero((at < len(item)) & (bin_[other] == bin_) & (both < size))
    if not len(fit):
        return None
    i = int(fit[both[fit].argmin()])
    return int(item[i]), int(item[other[i]]), int(bin_[i])


def _one(sizes: np.ndarray, where: np.ndarray, slack: np.ndarray, size: int, mates: np.ndarray) -> tuple[int, int, int] | None:
    """A document that two of the emptied bin, one of them of `size`, can take the place of: it, the other's index in `mates`, its bin."""
    order = np.argsort(mates, kind="stable")
    line = mates[order]
    item = np.flatnonzero(slack[where] > 0)
    # The largest mate that still fits, if both together are more than the document.
    at = np.searchsorted(line, sizes[item] + slack[where[item]] - size, "right") - 1
    gain = np.where(at >= 0, size + line[np.maximum(at, 0)] - sizes[item], 0)
    if not len(item) or gain.max() <= 0:
        return None
    i = int(gain.argmax())
    return int(item[i]), int(order[at[i]]), int(where[item[i]])


def pack(sizes: np.ndarray, capacity: int = LENGTH) -> np.ndarray:
    full = sizes == capacity
    out = np.empty(len(sizes), np.int64)
    rest = local_search(sizes[~full], best_fit(sizes[~full], capacity), capacity) if (~full).any() else np.zeros(0, np.int64)
    out[~full] = rest
    out[full] = np.arange(full.sum()) + (rest.max() + 1 if len(rest) else 0)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces (not texts) are dealt at random to groups of about `group`, each packed on its own: a group has a few
    thousand pieces at any size of input, and at most its last sequences are underfull.
    """
    found = cut(pieces(docs, tokenizer, length, id_col, text_col))
    groups = max(1, -(-found.count() // group))
    dealt = found.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins = pack(rows["length"].to_numpy(np.int64), length)
        order = np.argsort(bins, kind="stable")
        size, by = rows["length"].to_numpy(np.int64)[order], bins[order]
        to = np.cumsum(size) - size
        offset = np.empty(len(rows), np.int64)
        offset[order] = to - to[np.searchsorted(by, by)]
        return rows.assign(sequence_id=bins + rows["g"] * (1 << 32), offset=offset).drop(columns="g")

    return dealt.groupBy("g").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
