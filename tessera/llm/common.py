"""What the training-data operators share: shared folders, Arrow batches and vectorised text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised helpers take at a time, so that their 8-byte temporaries stay small.
CHUNK_BYTES = 1 << 21
#: An odd multiplier, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(df: DataFrame, *more: Column) -> DataFrame:
    """The rows as one column, `doc`, beside others: so no name of theirs clashes with what they are joined to."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *more)


def smallest(df: DataFrame, key: Column, most: int, *ties: str, rows: int | None = None) -> DataFrame:
    """The rows of the `most` smallest 64-bit hashes. Hashes far above them are dropped where they are read, so that
    what reaches the driver does not grow with the number of tasks."""
    rows = df.count() if rows is None else rows
    out = df.withColumn("_key", key)
    if rows > 4 * most:
        out = out.where(F.col("_key") < -(1 << 63) + int((1 << 64) * (2 * most / rows)))
    return out.orderBy("_key", *ties).limit(most).drop("_key")


def parts(df: DataFrame) -> int:
    """The session's shuffle width: it follows the input, so groups that are dealt over it stay bounded."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.empty(size, np.uint64)
            x[0], done = 1, 1
            while done < size:
                more = min(done, size - done)
                x[done : done + more] = x[:more] * np.uint64(pow(base, done, 1 << 64))
                done += more
            _powers[name] = x
    return _powers["up"][:n], _powers["down"][:n]


BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[ord("A") : ord("Z") + 1] = BYTE_KEYS[ord("a") : ord("z") + 1]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def prefix_hashes(data: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
    """sums[i]: the hash of data[:i]; span_hashes() reads any span's hash from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(keys[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span that depends on its content alone."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their text's bytes and its offsets, at most about `most` bytes at a time."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        for i, j in slices(offsets, most):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ and, for each text, how many words lie before it."""
    on = NOT_SPACE[data]
    before, after = np.zeros(len(on), bool), np.zeros(len(on), bool)
    before[1:], after[:-1] = on[:-1], on[1:]
    inner = offsets[(offsets > 0) & (offsets < len(on))]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles (A-Z lower-cased); with fewer words, one of them all."""
    start, end, first = words(data, offsets)
    h = span_hashes(prefix_hashes(data, LOWER_KEYS), start, end)
    at = mix(np.arange(1, n + 1, dtype=np.uint64))
    m = max(0, len(h) - n + 1)
    every = np.zeros(m, np.uint64)
    for j in range(n):
        every += mix(h[j : j + m] + at[j])
    every = mix(every)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(x) for x in mix(h[a:b] + at[: b - a])) + int(b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
