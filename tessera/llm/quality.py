"""Quality rules: repetition counts per document, and lines that too many documents of one host share.

Expressions and joins only. Defined cases: a null or empty text has no words and fails; a null host is a host of its
own; a line is counted once for each id, however often that id's rows or lines repeat (null is one id), against the
rows of its host, and equal rows are judged alike; ties on the first document of a line go to the smallest id (null
last); very long texts are judged whole; an empty table gives an empty result; only the id, text and host columns are
read, whatever else the table has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import whole_rows
from tessera.operators.graph import cut

SPACES = " \t\n\u000b\u000c\r"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Crowded lines (two hashes, a host and an id each) that are broadcast; with more of them lines are shuffled.
CROWDED = 100_000


@dataclass(frozen=True)
class Limits:
    """A line is above the limits if more documents of its host than both figures have it."""

    min_words: int = 50
    max_repeat_percent: int = 50
    line_documents: int = 20
    line_share: float = 0.005
    #: A document is depleted if fewer words, or a smaller share of them, are left.
    left_words: int = 10
    left_share: float = 0.2
    #: Whether the first document of a line keeps it, so that one copy stays in the corpus.
    spare_first: bool = True


def words_of(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def word_counts(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    df = docs.select(*keep, words_of(F.col(text)).alias("_w"), lines.alias("_l"), F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    word = lambda i, k: F.get(F.col("_w"), i + F.lit(k))
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, windows).alias("_h"),
    )
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(x["h"] == F.get(F.col("_s"), j)["h"], F.lit(False))
    found = F.filter("_s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_s").isNotNull(), F.size(covered)), F.lit(0)).cast("long")).drop("_h", "_s")


def base_failed(limits: Limits = Limits()) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def normal(line: Column) -> Column:
    """Lower case, digits as 0, single spaces: what counts as the same line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " "))


def plain_lines(text: Column) -> Column:
    """Normal forms of the lines with a word, in order."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return F.transform(lines, normal)


def line_key(plain: Column) -> Column:
    """Two hashes of a line, so that it is told apart among any number of lines."""
    return F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit(1), plain).alias("b"))


def crowded_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, limits: Limits = Limits()) -> DataFrame:
    """doc id, text hash, and each line hash of that document above its host's limits, with the words that go.

    Words and `times` (how many lines were met) are those of one row: repeated rows have the same lines at the same
    places. Lines are counted by (host, hash), with partial counts before the shuffle, so that a hot host or line is no hot task. The first document of a line keeps it, unless the limits say otherwise.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{host_col}`").alias("host"), plain_lines(F.col(f"`{text_col}`")).alias("ls"))
    once = rows.select("id", "host", F.explode_outer(F.array_distinct("ls")).alias("x")).where("x is not null").select("id", "host", line_key(F.col("x")).alias("k")).select("id", "host", "k.a", "k.b")
    # Each id once: Spark first deals by line and id, so that a line of very many documents is no hot task.
    counts = once.groupBy("host", "a", "b").agg(F.count_distinct(F.struct("id")).alias("n"), F.min("id").alias("first"))
    hosts = docs.groupBy(F.col(f"`{host_col}`").alias("_h")).agg(F.count("*").alias("docs"))
    few = counts.where(F.col("n") > limits.line_documents)
    crowded = few.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).where(F.col("n") > limits.line_share * F.col("docs"))
    crowded = crowded.select(F.col("host").alias("_host"), F.col("a").alias("_a"), F.col("b").alias("_b"), "first")
    lines = rows.select("id", "th", "host", F.posexplode_outer("ls").alias("p", "x")).where("x is not null").select("id", "th", "host", "p", line_key(F.col("x")).alias("k"), F.size(F.split("x", " ")).alias("n")).select("id", "th", "host", "p", "k.a", "k.b", "n")
    crowded = cut(crowded)
    few = F.broadcast(crowded) if crowded.count() <= CROWDED else crowded.hint("shuffle_hash")
    met = lines.join(few, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & F.col("host").eqNullSafe(F.col("_host")))
    if limits.spare_first:
        met = met.where(~F.col("id").eqNullSafe(F.col("first")))
    met = met.groupBy("id", "th", "host", "a", "b", "p").agg(F.max("n").alias("n"))
    per = met.groupBy("id", "th", "host", "a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("times"))
    return per.select("id", "th", "host", "a", "b", F.col("n").cast("long").alias("words"), "times")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """doc_id, the counts, base_failed, removed_words, removed_lines (hash pairs) and kept, a row for each document."""
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("_text"))
    counts = word_counts(ids, "_text", "doc_id", "th", "host").withColumn("base_failed", base_failed(limits))
    gone = crowded_lines(docs, id_col, text_col, host_col, limits)
    gone = gone.groupBy("id", F.col("th").alias("gth"), F.col("host").alias("ghost")).agg(F.sum("words").alias("removed_words"), F.collect_list(F.struct("a", "b")).alias("removed_lines"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("gth")) & F.col("host").eqNullSafe(F.col("ghost"))
    both = counts.join(gone, same, "left").drop("id", "gth", "ghost")
    left = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    depleted = F.col("removed_words").isNotNull() & ((left < limits.left_words) | (left < limits.left_share * F.col("n_words")))
    return both.select("doc_id", "th", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "removed_lines", (~(F.col("base_failed") | depleted)).alias("kept"))


def clean_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept documents with their columns, without the lines above the limits (n_chars follows the text).

    Null and empty texts are rejected; of repeated rows all stay or none; further columns stay as they are, whatever
    their names; an empty table stays empty.
    """
    # Written first: a filter pushed below the counts would write their expressions out many times over.
    verdict = cut(quality(docs, limits=limits)).where("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("host").alias("_host"), "removed_lines").dropDuplicates(["_id", "_th", "_host"])
    rows = whole_rows(docs, F.xxhash64("text").alias("_h"))
    both = rows.join(verdict, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")) & F.col("doc.source").eqNullSafe(F.col("_host")))
    text = F.col("doc.text")
    shorter = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("removed_lines"), line_key(normal(x)))), "\n")
    both = both.withColumn("left", F.when(F.col("removed_lines").isNull(), text).otherwise(shorter))
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return both.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
