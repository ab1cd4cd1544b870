"""A language detector that is trained: profiles of hashed character n-grams, and texts scored against them in one pass.

A profile is a language's log-likelihood of each of BUCKETS hashes of 1- to 4-grams, in whole steps of 1 / STEPS, so that
a score is a sum of integers and the same wherever it is taken. A model is BUCKETS numbers for each language, whatever
the number of texts it was made from; a task that counts or scores holds that much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: A prime, so that sums of multiplied characters spread; multipliers of an n-gram's characters and of its length.
BUCKETS, FACTORS, LENGTH_FACTOR = 65_521, (1_000_003, 2_750_159, 15_485_863, 32_452_843), 49_979_687
STEPS, PRIOR, LEAST_CHARS, MOST_LANGUAGES = 1024, 0.5, 20, 200
#: Characters that are taken at a time.
CHUNK = 1 << 18


def letters(c: Column | str) -> Column:
    """Lower case, what is no letter as one blank, a blank at either end."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(T.text(c)), "[^\\p{L}]+", " "), F.lit(" "))


def _hashed(texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some texts at a time, and (text among them, bucket) of their n-grams of one length, at most CHUNK of them."""
    every = np.cumsum([0, *map(len, texts)])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(every, every[i] + CHUNK, "right")) - 1)
        codes, ends = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32), every[i + 1 : j + 1] - every[i]
        for a in range(0, len(codes), CHUNK):
            own = codes[a : a + CHUNK + len(FACTORS) - 1].astype(np.int64)
            at = np.arange(a, min(a + CHUNK, len(codes)))
            who = np.searchsorted(ends, at, "right")
            left = ends[who] - at
            total = np.zeros(len(at), np.int64)
            for n, factor in enumerate(FACTORS, 1):
                more = own[n - 1 : n - 1 + len(at)]
                total[: len(more)] += more * factor
                inside = left >= n
                yield slice(i, j), who[inside], (total[inside] + n * LENGTH_FACTOR) % BUCKETS
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task, lang, bucket and n; one dense row of counts for each language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in set(langs):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for _, _, bucket in _hashed([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                own += np.bincount(bucket, minlength=BUCKETS)
    for lang, own in counts.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "bucket", "n"])


def profiles(labelled: DataFrame, body: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n of labelled texts; counted in each task before anything is sent, so at most BUCKETS rows a task and language."""
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(T.text(body)) >= LEAST_CHARS)).select(F.col(lang).alias("lang"), letters(body).alias("t"))
    return rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and, for each, the log-likelihood of every bucket in steps. The driver takes BUCKETS rows a language at most."""
    totals = {r.lang: int(r.n) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = np.zeros((len(totals), BUCKETS))
    langs = list(totals)
    table = counts.toPandas()
    found[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"].to_numpy(float)
    whole = np.array([totals[x] + PRIOR * BUCKETS for x in langs]).reshape(-1, 1)
    return langs, np.floor(np.log((found + PRIOR) / whole) * STEPS + 0.5).astype(np.int32)


def detector(model: tuple[list[str], np.ndarray]) -> Callable[[Column | str], Column]:
    """body -> its language; null for a text of under LEAST_CHARS characters or without a letter, and if there are no profiles."""
    langs, steps = model

    @F.pandas_udf("string")
    def run(body: pd.Series) -> pd.Series:
        texts = [t or "" for t in body]
        scores = np.zeros((len(langs), len(texts)))
        for some, who, bucket in _hashed(texts):
            for k in range(len(langs)):
                scores[k, some] += np.bincount(who, steps[k][bucket], some.stop - some.start)
        if not langs:
            return pd.Series([None] * len(texts), dtype=object)
        best = len(langs) - 1 - scores[::-1].argmax(0)  # of equal ones the last in order
        return pd.Series([langs[k] if t.strip() else None for k, t in zip(best, texts, strict=True)], dtype=object)

    def detect(body: Column | str) -> Column:
        return F.when(F.length(T.strip(T.text(body))) >= LEAST_CHARS, run(letters(body)))

    return detect
