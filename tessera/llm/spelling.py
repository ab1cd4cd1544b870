"""Spelling variants: words one edit apart, found by a frontier of states over a distributed trie.

A state (word, position, node, edits) says that so many characters of a word have led to a node of the trie of all
words. Every round joins the states with the edge table: a state without an edit follows its own edge, or spends its
edit on another one (replace) or on skipping a character (delete); a state with its edit spent needs the edge of its next
character. A spent state that ends at the end of a word is a pair of neighbours; insertions are deletions seen from the
other word, so pairs are taken both ways.

One edit lies in a word's first or second half, so words are searched in two tries, of the words and of the reversed
words, and states begin in the middle: nodes near a root, where all words meet, are never joined. An edge knows which
characters and lengths follow below it, so that states without a future are dropped before they are written, and an
edge to a single word ends the search at once. Hot nodes are split by skew joins. Words of LONG code points and more
would need a round for each of them; their pairs come from hashes of the word without each of its characters, and
Levenshtein's distance confirms them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import mix, prefix_hashes, span_hashes, utf8
from tessera.operators.graph import cut

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
LONG = 64
#: Runs counted in a task before they are handed on.
COUNTED = 1 << 18
#: One of so many runs of a document loses a character.
ONE_IN = 199
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))
#: Characters of two bytes and more that are no letters here.
OTHERS = re.compile(rb"[\xC2\xC4-\xF4][\x80-\xBF]+")
WORD_SCHEMA = "word string, n long"


def runs(text: bytes) -> list[bytes]:
    """The maximal runs [A-Za-z\\u00C0-\\u00FF]+ of six bytes and more, A-Z lower-cased. In UTF-8 the accented letters are C3 and one byte."""
    if not text.isascii():
        text = OTHERS.sub(b" ", text)
    return [w for w in text.translate(LETTERS).split() if len(w) >= LEAST_LENGTH]


def result(run: bytes, begun: int) -> bytes:
    """The run, or what is left of it where its hash says so; b"" if that is too short. begun: the crc of `<doc_id>:`."""
    h = zlib.crc32(run, begun)
    if h % ONE_IN == 0:
        word = run.decode()
        h %= len(word)
        run = (word[:h] + word[h + 1 :]).encode()
    return run if len(run) >= 2 * LEAST_LENGTH or len(run.decode()) >= LEAST_LENGTH else b""


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for k, begun in enumerate(batch.column(0).to_pylist()):
            begun = zlib.crc32(f"{'' if begun is None else begun}:".encode())
            for run, n in Counter(runs(data[offsets[k] : offsets[k + 1]].tobytes())).items():
                if word := result(run, begun):
                    counts[word] += n
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
    if counts:
        yield out()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct results of all texts with at least `least` occurrences. Null texts have none; a null doc_id is an empty one."""
    counted = docs.select(F.col("doc_id"), F.col("text")).mapInArrow(_occurrences, WORD_SCHEMA)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _char(word: Column | str, at: Column | int) -> Column:
    """The character at a place counted from 0; '' behind the end."""
    return F.substring(word, at + 1, F.lit(1)) if isinstance(at, Column) else F.substring(word, F.lit(at + 1), F.lit(1))


def _bit(c: Column) -> Column:
    """A bit for a character, of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))


def _length_bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(63)).cast("int"))


def trie(words: DataFrame) -> DataFrame:
    """Edges node -> child by the character c, from the depth on where searches begin, of nodes that two words share at least.

    words: way ('>' or '<'), word. ends: a word ends at the child; next, left: bits of the characters and the numbers of
    characters below it; only: the word, if there is a single one below.
    """
    depth = F.explode(F.sequence(F.lit(LEAST_LENGTH // 2), F.length("word")))
    steps = words.select("way", "word", depth.alias("d")).select(F.concat("way", F.substring("word", F.lit(1), F.col("d"))).alias("node"), _char("word", F.col("d")).alias("c"), "word", (F.length("word") - F.col("d") - 1).alias("rest"), _char("word", F.col("d") + 1).alias("then"))
    edges = steps.groupBy("node", "c").agg(
        F.count("*").alias("words"), F.min("word").alias("only"), F.max(F.col("rest") == 0).alias("ends"), F.bit_or(F.when(F.col("rest") > 0, _bit(F.col("then"))).otherwise(0)).alias("next"), F.bit_or(_length_bit(F.col("rest"))).alias("left"),
    )
    through = F.sum("words").over(Window.partitionBy("node"))  # the word that ends here, with no character, among them
    kept = edges.withColumn("through", through).where("through > 1 and c <> ''")  # one word alone has no neighbour below
    return kept.select("node", "c", "ends", "next", "left", F.when(F.col("words") == 1, F.col("only")).alias("only"))


def _round(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one edge each; near is set where a search has ended in a neighbour."""
    here, there, length = _char("word", F.col("at")), _char("word", F.col("at") + 1), F.length("word")
    fresh = F.col("edits") == 0
    moves = F.array(
        F.when((F.col("c") == here), F.struct((F.col("at") + 1).alias("at"), F.col("edits").alias("edits"))),
        F.when(fresh & (F.col("c") != here), F.struct((F.col("at") + 1).alias("at"), F.lit(1).alias("edits"))),
        F.when(fresh & (F.col("c") == there) & (there != here), F.struct((F.col("at") + 2).alias("at"), F.lit(1).alias("edits"))),
    )
    joined = states.join(edges.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & (fresh | (F.col("c") == here)))
    moved = joined.select("word", "way", F.concat("node", "c").alias("node"), "ends", "next", "left", "only", F.explode(F.array_compact(moves)).alias("m")).select("*", "m.at", "m.edits")
    rest = length - F.col("at")
    spent, bare = F.col("edits") == 1, F.substring("node", F.lit(2), F.length("node"))
    near = (
        F.when(spent & F.col("only").isNotNull(), F.when(F.concat(bare, F.substring("word", F.col("at") + 1, length)) == F.col("only"), F.col("only")))
        .when(spent & (rest == 0) & F.col("ends"), bare)
        .when(~spent & (rest == 1) & F.col("ends"), bare)  # its last character deleted
    )
    goes_on = F.col("only").isNull() & (rest > 0) & ((F.col("next").bitwiseAND(_bit(_char("word", F.col("at"))))) != 0) & (~spent | (F.col("left").bitwiseAND(_length_bit(rest)) != 0))
    return moved.select("way", "word", "at", "node", "edits", near.alias("near"), goes_on.alias("goes_on")).where("goes_on or near is not null")


def _without_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and place, hashes of what lies in front of it and behind it: without the character there (gone), and with it."""
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for k, word in enumerate(batch.column(0).to_pylist()):
            own = data[offsets[k] : offsets[k + 1]]
            sums, size, first = prefix_hashes(own), len(own), np.flatnonzero((own & 0xC0) != 0x80)
            edge = np.append(first, size)
            front, behind = (span_hashes(sums, *x) for x in ((np.zeros_like(edge), edge), (edge, np.full_like(edge, size))))
            key = np.concatenate([mix(front[:-1] + mix(behind[1:])), mix(front + mix(behind))]).view(np.int64)
            place = np.concatenate([np.arange(len(first)), np.arange(len(edge))]).astype(np.int32)
            gone = np.arange(len(key)) < len(first)
            yield pa.RecordBatch.from_arrays([pa.array([word] * len(key), pa.string()), pa.array(place), pa.array(key), pa.array(gone)], names=["word", "place", "key", "gone"])


def long_pairs(words: DataFrame) -> DataFrame:
    """a, b: words of LONG code points and more that are one edit apart. A key is shared by an alphabet's words at most."""
    keys = words.where(F.length("word") >= LONG).select("word").mapInArrow(_without_each, "word string, place int, key long, gone boolean")
    left, right = keys.where("gone").select(F.col("word").alias("a"), "place", "key"), keys.select(F.col("word").alias("b"), "place", "key")
    return left.join(right, ["place", "key"]).where("a <> b").select("a", "b").distinct().where(F.levenshtein("a", "b", 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, both ways: the words that differ by exactly one inserted, deleted or replaced code point.

    words: word, of LEAST_LENGTH code points and more, each once. Rounds end when no state is left, at LONG / 2 at most.
    """
    short = words.where(F.length("word") <= LONG).select(F.lit(">").alias("way"), "word")
    both = short.unionByName(short.select(F.lit("<").alias("way"), F.reverse("word").alias("word")))
    edges = cut(trie(both))
    begin = F.when(F.col("way") == ">", F.floor(F.length("word") / 2)).otherwise(F.ceil(F.length("word") / 2)).cast("int")
    states = both.select("way", "word", begin.alias("at")).select("way", "word", "at", F.concat("way", F.substring("word", F.lit(1), F.col("at"))).alias("node"), F.lit(0).alias("edits"))
    found = []
    while True:
        reached = cut(_round(states, edges))
        found.append(reached.where("near is not null").select("way", "word", "near"))
        states = reached.where("goes_on").drop("near", "goes_on")
        if states.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    straight = lambda c: F.when(F.col("way") == ">", F.col(c)).otherwise(F.reverse(c))
    pairs = pairs.select(straight("word").alias("a"), straight("near").alias("b")).unionByName(long_pairs(words))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: its best-known neighbour, if that is `times` as frequent, and where forms lead.

    A form is more frequent than its word, so forms never go round; roots are found by doubling the jumps.
    """
    words = cut(vocabulary(docs, least))
    pairs = near_pairs(words)
    known = pairs.join(words.select(F.col("word").alias("_w"), F.col("n").alias("_n")), F.col("b") == F.col("_w"))
    best = known.groupBy(F.col("a").alias("_a")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("b").alias("b"))).alias("m"))
    named = words.join(best, F.col("word") == F.col("_a"), "left")
    has = -F.col("m.n") >= times * F.col("n")
    forms = cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("m.b")).alias("form"), F.when(has, -F.col("m.n")).alias("form_n")))
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        jumped = cut(roots.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        roots = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    roots = roots.withColumnRenamed("word", "_w")
    return forms.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
