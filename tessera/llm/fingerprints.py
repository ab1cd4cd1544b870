"""Document fingerprints of closed syncmers.

A k-mer is an anchor if its minimal inner s-mer lies at either edge: its own characters decide that, not what stands
around it. A fingerprint keeps the anchors of the smallest hashes with their places; two are alike as far as they
share anchors in the same order. Defined cases: a null text is empty and has the empty fingerprint (two of them are
alike, 1.0); a text shorter than k has one anchor, the whole text; equal texts have equal fingerprints; documents of
one id are ordered by text; the next of the last document is the first, and of a lone document itself; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, parts, powers
from tessera.operators.graph import cut

K, S, ANCHORS, PLACES = 16, 7, 64, 1 << 24


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's closed syncmers; all operations are on whole arrays."""
    n = len(points)
    if n < k:
        return (np.zeros(1, np.int64), mix(np.array([_whole(points)], np.uint64))) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points + np.uint64(1)) * up, out=sums[1:])
    inner = mix((sums[s:] - sums[:-s]) * down[: n - s + 1])
    width = k - s + 1
    least, have = inner, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    return at, mix((sums[at + k] - sums[at]) * down[at])


def _whole(points: np.ndarray) -> int:
    x = 0x51ED270B
    for p in points:
        x = (x * 0x100000001B3 + int(p) + 1) & 0xFFFFFFFFFFFFFFFF
    return x


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The ANCHORS smallest distinct 32-bit hashes, in order, and the first place of each."""
    at, h = syncmers(code_points(text))
    h = (h >> np.uint64(32)).astype(np.uint32)
    if len(h) > 8 * ANCHORS:  # only the small ones need sorting
        few = np.flatnonzero(h <= np.partition(h, 4 * ANCHORS)[4 * ANCHORS])
        if len(np.unique(h[few])) >= ANCHORS:
            at, h = at[few], h[few]
    h, first = np.unique(h, return_index=True)
    return h[:ANCHORS], np.minimum(at[first[:ANCHORS]], PLACES - 1)


def fingerprint(found: tuple[np.ndarray, np.ndarray]) -> str:
    """8 hex digits of hash and 6 of place for each anchor."""
    return "".join(f"{h:08x}{p:06x}" for h, p in zip(found[0].tolist(), found[1].tolist(), strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Anchors of the joint smallest that both have, in the same order, by the number of joint smallest."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    joint = np.union1d(a[0], b[0])[: max(len(a[0]), len(b[0]))]
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    keep = both <= joint[-1]
    chain: list[int] = []  # the longest run of places that rise in both
    for p in b[1][j[keep]][np.argsort(a[1][i[keep]], kind="stable")].tolist():
        k = bisect_left(chain, p)
        chain[k : k + 1] = [p]
    return len(chain) / len(joint)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, f, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """f over batches of (doc_id, text, next text) in ascending doc_id, dealt out by ranges of ids.

    Every range also gets the first document of the next one (the last range the very first), so texts are shuffled
    once and no task needs another's rows. What the driver sees is one id for each range.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = max(2, parts(docs))
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()
    cuts = sorted({c for c in (cuts["q"] or []) if c is not None}) if cuts else []
    part = F.lit(0)
    if cuts:
        part = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("part", part)
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f")).orderBy("part").collect()
    if not firsts:
        return rows.mapInArrow(lambda batches: iter(()), schema)
    # The range before the one a document begins; a range of ids without documents is no range.
    before = {firsts[i]["part"]: firsts[i - 1]["part"] for i in range(len(firsts))}
    heads = F.create_map(*[x for r in firsts for x in (F.lit(r["part"]), F.lit(before[r["part"]]))])
    lowest = F.create_map(*[x for r in firsts for x in (F.lit(r["part"]), F.lit(r["f"]["doc_id"]))])
    head = F.col("doc_id").eqNullSafe(F.try_element_at(lowest, F.col("part")))
    extra = rows.where(head).select("doc_id", "text", F.try_element_at(heads, F.col("part")).alias("part"), F.lit(True).alias("extra"))
    dealt = rows.withColumn("extra", F.lit(False)).unionByName(extra).repartitionByRange(n, "part").sortWithinPartitions("part", "extra", F.col("doc_id").isNotNull(), "doc_id", "text")
    return dealt.mapInArrow(lambda batches: f(_pairs(batches)), schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held, done = None, None
    for batch in batches:
        for row in zip(*[batch.column(i) for i in range(4)], strict=True):
            doc, text, part, extra = row[0], row[1].as_py(), row[2].as_py(), row[3].as_py()
            if held is not None and held[2] == part:
                yield held[0], held[1], text
                held = None
            if not extra:
                held = (doc, text, part)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}
        out: list[tuple] = []
        ids: list = []

        def batch() -> pa.RecordBatch:
            names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], ids[0].type), *[pa.array(c) for c in zip(*out, strict=True)]], ["doc_id", *names])

        for doc, text, following in pairs:
            mine = kept.pop("next", None) if kept.get("text") == text else None
            mine = mine or anchors(text)
            after = anchors(following)
            kept["next"], kept["text"] = after, following
            changed = edited(text, following)
            other = anchors(changed)
            ids.append(doc)
            out.append((len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(mine), fingerprint(other), likeness(mine, other), likeness(mine, after)))
            if len(out) == 1000:
                yield batch()
                ids.clear()
                out.clear()
        if out:
            yield batch()

    return with_next(docs, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", id_col, text_col)
