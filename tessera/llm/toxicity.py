"""Toxicity with noisy-channel deobfuscation.

Disguised tokens (leetspeak, letters spaced by blanks, line breaks or signs, repeated letters) become lattices of
characters, decoded by Viterbi under a character trigram model of the whole corpus; the words of the restored text are
then scored. Defined cases: a null or empty text has no words and the score of a text without signs; equal texts have
equal scores; a very long text or token is read whole (runs of one character count as three); repeated rows are scored
alike; of several labels of one document the highest counts; equal signs are ordered by name; without labelled rows
every score is 0; an empty table gives an empty result; only the id and text columns (and id and label of the labels)
are read, whatever else the tables have.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, smallest

#: Labelled rows that are learned from (smallest seeded hashes first); signs are words of theirs, so this bounds them too.
SAMPLE = 12_000
FEATURES = 4
CLASSES = 28  # a to z, another letter, anything else
#: What a character may stand for; one that is not listed stands for itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
FILLERS = set(".-_*~'`^:,/\\ ")
LEET_COST, DROP_COST, REPEAT_COST, KEEP_COST = 0.7, 0.2, 0.4, 9.0
LETTERS = re.compile(r"[^\W\d_]+")
TWICE = re.compile(r"([^\W\d_])\1")
RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S)+(?!\S)")
#: What may stand around a token; of these some may be letters in disguise.
EDGES = ".,;:!?\"'()[]{}<>#%&*$|-_~"
PLAIN_EDGES = "".join(c for c in EDGES if c not in LEET)
CACHED = 200_000


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigrams of character classes over all texts: tasks add up their bytes, Spark adds up the tasks."""
    classes = np.full(256, CLASSES - 1, np.int64)
    for c in range(26):
        classes[[ord("a") + c, ord("A") + c]] = c
    classes[0xC3:0xF5] = 26  # the first byte of another letter stands for it; those that follow are skipped
    follows = np.zeros(256, bool)
    follows[0x80:0xC0] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for _, data, _ in chunks(batches, "text"):
            c = classes[data[~follows[data]]]
            if len(c) > 2:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    per = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES**3)
    for row in per.collect():  # CLASSES ** 3 rows at most
        counts[row["gram"]] = row["n"]
    return counts.reshape(CLASSES, CLASSES, CLASSES)


def char_model(counts: np.ndarray) -> np.ndarray:
    """Costs (-log2) of a class after two classes, smoothed by the bigrams."""
    two = counts.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    three = (counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20)
    return -np.log2(three)


def class_of(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26 if c.isalpha() else 27


def restore(token: str, costs: np.ndarray) -> str:
    """The likeliest letters behind a token: Viterbi over each character's readings, states being the last two letters.

    A digit or sign may stay, be read as a letter or be dropped as filler; a letter that repeats the one before may go.
    """
    beam: dict[tuple[str, str], tuple[float, str]] = {(" ", " "): (0.0, "")}
    before = ""
    for c in token:
        readings: list[tuple[str, float]] = []
        if c.isalpha():
            readings.append((c, 0.0))
            if c == before:
                readings.append(("", REPEAT_COST))
        else:
            readings += [(x, LEET_COST) for x in LEET.get(c, "")]
            readings.append(("", DROP_COST if c in FILLERS else KEEP_COST + 4))
            if c not in FILLERS:
                readings.append((c, KEEP_COST))
        step: dict[tuple[str, str], tuple[float, str]] = {}
        for (x, y), (cost, text) in beam.items():
            for z, more in readings:
                key = (y, z) if z else (x, y)
                total = cost + more + (costs[class_of(x), class_of(y), class_of(z)] if z else 0.0)
                if key not in step or total < step[key][0]:
                    step[key] = (total, text + z)
        beam, before = step, c
    return min((cost + costs[class_of(x), class_of(y), 27], text) for (x, y), (cost, text) in beam.items())[1]


def disguised(token: str) -> bool:
    """Letters among other characters, signs that stand for letters, or a letter that repeats the one before; not a number."""
    if token.isalpha():
        return TWICE.search(token) is not None
    return any(c.isalpha() or c in LEET and not c.isdigit() for c in token) and sum(c.isalpha() or c in LEET for c in token) >= 2


def spaced(text: str) -> Iterator[str]:
    """Runs of one-character tokens as one token each; where some gaps are wider than others, also what stands between these."""
    for run in SPACED.finditer(text):
        letters = run[0].split()
        if len(letters) >= 3:
            yield "-".join(letters)
            gaps = re.findall(r"\s+", run[0])
            least = min(map(len, gaps))
            if max(map(len, gaps)) > least:
                part = [letters[0]]
                for gap, letter in zip(gaps, letters[1:], strict=True):
                    if len(gap) > least:
                        yield "-".join(part)
                        part = []
                    part.append(letter)
                yield "-".join(part)


class Reader:
    """Words of a text with disguises restored; tokens once read are kept, up to CACHED of them."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.kept = costs, {}

    def words(self, token: str) -> tuple[str, ...]:
        bare, wide = token.strip(EDGES), token.strip(PLAIN_EDGES)
        found = LETTERS.findall(bare)
        # A sign at the edge may be a letter; exclamation marks behind a word are none.
        for shape in dict.fromkeys((bare, wide if wide.rstrip("!") != bare else bare)):
            if shape and disguised(shape):
                found = [*LETTERS.findall(restore(RUN.sub(r"\1\1\1", shape), self.costs)), *found]
        return tuple(dict.fromkeys(found))

    def tokens(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        every = low.split()
        found = set(every)
        if sum(len(t) == 1 for t in found) and "111" in "".join("1" if len(t) == 1 else "0" for t in every):
            found.update(spaced(low))  # letters that stand apart become one token
        return found

    def signs(self, token: str) -> list[str]:
        out = []
        for w in self.words(token):
            out.append(w)
            out += ["^" + w[:n] for n in (4, 5) if len(w) >= n]
        return out

    def scored(self, token: str, weights: dict[str, float]) -> float:
        if token not in self.kept:
            if len(self.kept) >= CACHED:
                self.kept.clear()
            self.kept[token] = max((weights[s] for s in self.signs(token) if s in weights), default=0.0)
        return self.kept[token]

    def found(self, text: str | None, weights: dict[str, float]) -> list[tuple[float, str]]:
        """The tokens with a sign, strongest first."""
        found, kept = [], self.kept
        for t in self.tokens(text):
            x = kept.get(t)
            if x is None:
                x = self.scored(t, weights)
            if x:
                found.append((x, t))
        return sorted(found, reverse=True)


def features(found: list[tuple[float, str]]) -> list[float]:
    """The strongest sign, its square, the second, and how many there are."""
    top = found[0][0] if found else 0.0
    return [top, top * top / 10, found[1][0] if len(found) > 1 else 0.0, math.log1p(len(found))]


def learn(docs: DataFrame, labels: DataFrame, costs: np.ndarray, held_out, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], np.ndarray]:
    """Sign weights (smoothed log odds) and a logistic regression over a text's four features, from labelled rows not held out."""
    few = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    few = smallest(few.groupBy("doc_id").agg(F.max("label").alias("label")), F.xxhash64(F.lit(7), "doc_id"), sample, "doc_id")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(few), "doc_id").select("text", "label")  # `sample` rows at most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, seen = Reader(costs), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                seen[label > 0].update({s for t in reader.tokens(text) for s in reader.signs(t)})
        yield pd.DataFrame([(s, seen[0][s], n) for s, n in seen[1].items()] + [(s, n, 0) for s, n in seen[0].items() if s not in seen[1]], columns=["sign", "n0", "n1"])

    size = rows.groupBy("label").count().collect()
    n0, n1 = (sum(r["count"] for r in size if (r["label"] > 0) == k) for k in (False, True))
    if not n0 or not n1:
        return {}, np.zeros(FEATURES + 1)
    weight = F.log((F.col("n1") + 0.1) / (n1 + 0.2)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    per = rows.mapInPandas(count, "sign string, n0 long, n1 long").groupBy("sign").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = per.where("n1 >= 3").withColumn("w", weight).where("w > 2")
    weights = {r["sign"]: r["w"] for r in best.collect()}

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(costs)
        for batch in batches:
            yield pd.DataFrame([[*features(reader.found(t, weights)), y] for t, y in zip(batch["text"], batch["label"], strict=True)], columns=["a", "b", "c", "d", "y"])

    table = rows.mapInPandas(rows_of, "a double, b double, c double, d double, y int").toPandas().sort_values(["a", "b", "c", "d", "y"])  # `sample` rows at most
    x, y = np.hstack([table[["a", "b", "c", "d"]].to_numpy(), np.ones((len(table), 1))]), (table["y"] > 0).to_numpy(float)
    model = np.zeros(FEATURES + 1)
    for _ in range(40):  # Newton steps of a ridge logistic regression, each row counting the same
        p = 1 / (1 + np.exp(-np.clip(x @ model, -30, 30)))
        h = (x * (p * (1 - p) / len(y))[:, None]).T @ x + 1e-4 * np.eye(FEATURES + 1)
        model = model - np.linalg.solve(h, x.T @ ((p - y) / len(y)) + 1e-4 * model)
    return weights, model


def held_out_fifth(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, and the signs found in the restored text (strongest first), a row for each document."""
    costs = char_model(char_counts(docs, text_col))
    weights, model = learn(docs, labels, costs, held_out_fifth, sample, id_col, text_col, label_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(costs)
        for batch in batches:
            found = [reader.found(t, weights) for t in batch["text"]]
            x = np.array([[*features(f), 1.0] for f in found]).reshape(-1, FEATURES + 1)
            score = 1 / (1 + np.exp(-np.clip(x @ model, -30, 30))) if weights else np.zeros(len(x))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= 0.5).astype("int32"), "signs": [" ".join(t for _, t in f) for f in found]})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(held_out_fifth(F.col(f"`{id_col}`")), F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int, signs string")
