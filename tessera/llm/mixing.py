"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a quota of blocks by highest quotients, the quota is dealt to the source's shards the same way, and
each shard chooses its blocks by a seeded order. Blocks have BLOCK words; sources whose target is less than FINE of
them are dealt single words instead, so that rounding to blocks does not move a small source from its target. The
highest quotients are found by a search for the divisor they must exceed, so parties are only ever summed up, and no
task lists or sorts them all.

Defined cases: a null text has size 0 and takes nothing; null is a source of its own, last in order; repeated rows are
documents of their own, and equal ones may share what their id and text take; a source without words has target 0;
equal quotients go to the first party in order; a very long text is one document of its shard; an empty table gives an
empty result; only the id, text and source columns are read, whatever else the table has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, whole_rows, words
from tessera.operators.graph import cut, numbered

#: Words of a block, words of a shard (a sum over documents in one shard stays in one task), and the most passes over a source.
BLOCK, SHARD, MOST = 64, 400_000, 3
#: A source of fewer blocks is dealt single words.
FINE = 256
#: Divisors tried at once, and quotients of a group that may be listed and ranked once the divisor is known to lie among them.
TRIED, LISTED = 32, 10_000
#: A prime: blocks a multiple of it apart are chosen one after the other.
STEP = 2_147_483_647


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, th (hash of the text) and size, its number of words: counted on the bytes of whole batches."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("th"), F.col(f"`{text_col}`").alias("text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "th"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(words(data, offsets)[2]), pa.int64())], ["doc_id", "source", "th", "size"])

    return rows.mapInArrow(count, f"{kinds}, size long")


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target: shares of all words by weight 1, 2, 3, repeating in source order; a target
    stops at `most` times its source's size and the excess is reshared by weight until none is above.

    The rule's own rounds: each is one sum over the sources, and what the driver keeps is the words of a unit of weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = cut(numbered(per, "number", F.col("source").isNull(), F.encode("source", "UTF-8")))
    per = per.select("source", "source_size", ((F.col("number") - 1) % 3 + 1).cast("double").alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"))
    total, weights = per.agg(F.sum("source_size"), F.sum("weight")).first()
    unit, before = (total or 0) / (weights or 1), None
    while True:
        above = F.col("weight") * unit > F.col("cap")
        full, rest = per.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if full == before or not rest:
            return per.select("source", "source_size", "weight", F.least("cap", F.col("weight") * unit).alias("target"))
        unit, before = (total - (full or 0)) / rest, full


def sainte_lague(votes: DataFrame, key: list[str], vote: Column, seats: Column, within: list[str], listed: int = LISTED) -> DataFrame:
    """votes with `seats`: within each group, `seats` seats go one by one to the highest vote / (2 * seats held + 1).

    A party holds as many seats as its quotients exceed the least winning one, so the search is for a divisor d with
    the seats' number of quotients vote / (held + 1/2) above it. Every round sums up TRIED divisors between the bounds;
    once at most `listed` quotients of a group lie between them, these are ranked.
    """
    df = votes.withColumn("_v", vote.cast("double")).withColumn("_n", seats.cast("long"))
    held = lambda d: F.greatest(F.lit(0), F.ceil(F.col("_v") / d - F.lit(0.5))).cast("long")
    groups = df.where("_v > 0").groupBy(*within).agg(F.sum("_v").alias("_all"), F.count("*").alias("_few"), F.max("_v").alias("_top"), F.max("_n").alias("_s"))
    half = F.col("_few") / 2
    high = F.when(F.col("_s") > half, F.least(2 * F.col("_top"), F.col("_all") / (F.col("_s") - half))).otherwise(2 * F.col("_top"))
    names = [f"_g_{c}" for c in within]
    bounds = cut(groups.select(*[F.col(c).alias(g) for c, g in zip(within, names, strict=True)], "_s", (F.col("_all") / (F.col("_s") + half) * (1 - 1e-9)).alias("_low"), (high * (1 + 1e-9)).alias("_high"), F.lit(None).cast("long").alias("_sure")))

    def bounded() -> DataFrame:
        on = [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(within, names, strict=True)]
        return df.join(bounds, on, "left") if within else df.crossJoin(F.broadcast(bounds))  # one row without groups

    for _ in range(12):
        tried = [F.col("_low") * F.pow(F.col("_high") / F.col("_low"), F.lit(i / TRIED)) for i in range(TRIED)] + [F.col("_high")]
        sums = bounded().where("_v > 0").groupBy(*names, "_s", "_low", "_high").agg(*[F.sum(held(d)).alias(f"_c{i}") for i, d in enumerate(tried)])
        sums = sums.withColumn("_c", F.array(*[F.col(f"_c{i}") for i in range(TRIED + 1)])).withColumn("_d", F.array(*tried))
        # The first of the rising divisors that not too many quotients exceed, and the one before it.
        sums = sums.withColumn("_at", F.array_position(F.transform("_c", lambda c: c <= F.col("_s")), F.lit(True)).cast("int"))
        exact = F.element_at("_c", F.col("_at")) == F.col("_s")
        last = F.when(exact, F.col("_at")).otherwise(F.greatest(F.lit(1), F.col("_at") - 1))
        bounds = cut(sums.select(*names, "_s", F.element_at("_d", last).alias("_low"), F.element_at("_d", F.col("_at")).alias("_high"), F.element_at("_c", F.col("_at")).alias("_sure"), (F.element_at("_c", last) - F.element_at("_c", F.col("_at"))).alias("_open")))
        widest = bounds.agg(F.max("_open")).first()[0]
        bounds = bounds.drop("_open")
        if not widest or widest <= listed:
            break
    df = bounded().withColumn("_base", F.when(F.col("_v") > 0, held(F.col("_high"))).otherwise(F.lit(0)))
    open_ = df.where("_v > 0").withColumn("_to", held(F.col("_low"))).where(F.col("_to") > F.col("_base"))
    quotients = open_.select(*dict.fromkeys([*key, *within]), "_v", (F.col("_s") - F.col("_sure")).alias("_left"), F.explode(F.sequence(F.col("_base"), F.col("_to") - 1)).alias("_h"))
    rank = Window.partitionBy(*within).orderBy((F.col("_v") / (2 * F.col("_h") + 1)).desc(), *key)
    won = quotients.withColumn("_r", F.row_number().over(rank)).where("_r <= _left").groupBy(*key).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(k).alias(f"_k_{k}") for k in key], "_won")
    out = df.join(won, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    return out.select(*votes.columns, (F.coalesce("_base", F.lit(0)) + F.coalesce("_won", F.lit(0))).cast("long").alias("seats"))


def mix_sources(docs: DataFrame, seed: int = 7, block: int = BLOCK, shard_words: int = SHARD, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, th (the text's hash), size, source, source_size, target, taken; texts never leave the first scan.

    A shard lays its documents end to end in a seeded order, so block b holds words b * block to (b + 1) * block; a
    quota of q blocks takes every block q // blocks times and the first q % blocks of a seeded order once more.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col))
    goals = targets(sized, most)
    goals = cut(goals.withColumn("block", F.when(F.col("target") >= FINE * block, F.lit(block)).otherwise(F.lit(1)).cast("long")))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    goal = goals.select(F.col("source").alias("_s"), "source_size", "target", "block")
    rows = sized.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "th", "size", "source", "source_size", "target", "block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), shards).alias("shard"))
    per = cut(rows.where("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("block").alias("block")))
    kinds = goals.groupBy(F.col("block").alias("_b")).agg(F.round(F.sum("target") / F.first("block")).cast("long").alias("_all"))  # two rows: blocks and single words
    seats = sainte_lague(goals.join(F.broadcast(kinds), F.col("block") == F.col("_b")).drop("_b"), ["source"], F.col("target"), F.col("_all"), ["block"])
    seats = seats.select(F.col("source").alias("_s"), F.col("seats").alias("_seats"))
    per = per.join(seats, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quota = sainte_lague(per, ["source", "shard"], F.col("words"), F.col("_seats"), ["source"]).withColumn("blocks", F.ceil(F.col("words") / F.col("block")))
    quota = quota.select(F.col("source").alias("_s"), F.col("shard").alias("_k"), F.least("seats", most * F.col("blocks")).alias("seats"), "blocks")
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "th"), "doc_id", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_to", F.sum("size").over(line)).withColumn("_from", F.col("_to") - F.col("size"))
    both = rows.join(quota, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_k")), "left")
    spans = F.sequence(F.floor(F.col("_from") / F.col("block")), F.floor((F.col("_to") - 1) / F.col("block")))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks"))
    chosen = lambda b: F.pmod(b * F.lit(STEP).cast("long") + start, F.col("blocks")) < F.col("seats") % F.col("blocks")
    part = lambda b: F.least(F.col("_to"), (b + 1) * F.col("block")) - F.greatest(F.col("_from"), b * F.col("block"))
    again = F.aggregate(spans, F.lit(0).cast("long"), lambda a, b: a + F.when(chosen(b), part(b)).otherwise(F.lit(0).cast("long")))
    taken = F.when((F.col("size") > 0) & (F.col("blocks") > 0), F.floor(F.col("seats") / F.col("blocks")) * F.col("size") + F.when(F.col("seats") % F.col("blocks") > 0, again).otherwise(0))
    return both.select("doc_id", "th", "size", "source", "source_size", "target", F.least(F.coalesce(taken, F.lit(0)), most * F.col("size")).cast("long").alias("taken"))


def copies(mixed: DataFrame, seed: int = 7, shard_words: int = SHARD) -> DataFrame:
    """mix_sources' rows that have a word, with `copies`, the whole documents that what is taken of them comes to.

    Systematic rounding: a shard lays its documents' taken / size end to end, by size, and a document gets a copy for
    each whole number its stretch crosses, counted from a seeded start. So each document is taken as often as its
    share says on average, however long it is, and the kept words of a shard stay within its longest document of what it takes.
    """
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    line = Window.partitionBy("source", "_shard").orderBy("size", F.xxhash64(F.lit(seed + 2), "doc_id", "th"), "doc_id", "th", "taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.pmod(F.xxhash64(F.lit(seed + 3), "source", "_shard"), F.lit(1_000_000))
    # Shares as whole millionths, so that a sum does not depend on rounding; whole copies are exact.
    part = F.round((F.col("taken") % F.col("size")) * 1e6 / F.col("size")).cast("long")
    rows = mixed.where("size > 0").withColumn("_shard", shard).withColumn("_part", part)
    rows = rows.withColumn("_to", F.sum("_part").over(line) + start)
    more = F.floor(F.col("_to") / 1e6) - F.floor((F.col("_to") - F.col("_part")) / 1e6)
    return rows.withColumn("copies", (F.floor(F.col("taken") / F.col("size")) + more).cast("int")).drop("_shard", "_part", "_to")


def repeated(docs: DataFrame, seed: int = 7, shard_words: int = SHARD, **options) -> DataFrame:
    """The documents as the mix takes them: each as many times as its taken words make whole documents (see `copies`), up to the most.

    Copies are joined back by id, text hash and source; repeated rows of one document share what they take evenly, the
    first by content taking what is left over. Documents without a word are not taken; further columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    each = copies(cut(mix_sources(docs, seed=seed, shard_words=shard_words, **options)), seed, shard_words)
    taken = cut(each.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("source").alias("_s")).agg(F.sum("copies").alias("_n"), F.count("*").alias("_rows")).where("_n > 0"))
    keyed = whole_rows(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))

    def joined(of: DataFrame) -> DataFrame:
        return keyed.join(of, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")) & F.col("doc.source").eqNullSafe(F.col("_s")))

    def laid(rows: DataFrame) -> DataFrame:
        return rows.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("doc.*")

    out = laid(joined(taken.where("_rows = 1")))
    several = taken.where("_rows > 1")
    if several.isEmpty():
        return out
    place = Window.partitionBy("_id", "_th", "_s").orderBy(F.xxhash64(F.to_json("doc")))
    rows = joined(several).withColumn("_k", F.row_number().over(place))
    return out.unionByName(laid(rows.withColumn("_n", F.floor(F.col("_n") / F.col("_rows")) + F.when(F.col("_k") <= F.col("_n") % F.col("_rows"), 1).otherwise(0))))
