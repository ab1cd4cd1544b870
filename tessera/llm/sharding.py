"""Shards that each hold the mixture: proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's place among all is its fractional rank,
(rank - 1/2) / rows of its source, so any stretch of that order holds every source in proportion. The order is cut into
shards of equal rows (`rows`, counts at most one apart) or of nearly equal bytes (`bytes`).

Rows: a null source is a source of its own; a null or empty text has 8 bytes and the crc of nothing; rows that repeat in
full take one place each; ties of the shuffle (equal id, text size and crc) are in any order, which gives the same rows.
An empty table has no shards; with fewer rows than shards some stay empty. Texts are not moved for an assignment, only
written_shards() moves them, once. Other columns, whatever their names, are passed over or kept as `doc`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import whole_rows
from tessera.operators.graph import cut

SHARDS, SEED = 24, 20
#: Added to a text's bytes: what a row takes besides.
ROW_BYTES = 8
IN_RANGE = "_spot & 8589934591"  # the lower 33 bits of monotonically_increasing_id(): the place in a partition


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """The rows sorted by ranges and written once, with _range and _spot (from 0 in each range): no task has more than its range."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", F.monotonically_increasing_id())
    return cut(placed.withColumns({"_range": F.expr("shiftright(_spot, 33)"), "_spot": F.expr(IN_RANGE)}))


def ranked(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The rows with _rank (from 1, in each group and order) and _group_rows. A hot group lies in as many ranges as it fills."""
    placed = in_order(df, F.col(group), *order)
    per = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_spot").alias("_first"))  # one row for each range, and for each group
    before = Window.partitionBy(group).orderBy("_range")
    known = per.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_group_rows"),
    )
    return placed.join(known, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g"))).select(*df.columns, (F.col("_before") + F.col("_spot") - F.col("_first") + 1).alias("_rank"), "_group_rows")


def interleaved(docs: DataFrame, seed: int = SEED, whole: bool = False) -> DataFrame:
    """doc_id, source, size, text_crc32 and the fractional rank, in the order of the interleaving (_range, _spot); with `whole`, the row as `doc`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [F.col("doc_id"), F.col("source"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")]
    rows = whole_rows(docs, *columns) if whole else docs.select(*columns)
    rows = rows.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    ties = [F.col(c) for c in ("doc_id", "size", "text_crc32")]
    share = (2 * F.col("_rank") - 1) / (2 * F.col("_group_rows")).cast("double")
    rows = ranked(rows, "source", F.col("_key"), *ties).withColumn("share", share).drop("_rank", "_group_rows")
    return in_order(rows, F.col("share"), F.col("source"), F.col("_key"), *ties).drop("_key")


def sharded(docs: DataFrame, shards: int = SHARDS, law: str = "rows", seed: int = SEED, whole: bool = False) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard (from 0) and slot (from 0, gapless in a shard); with `whole`, the row as `doc`.

    `rows`: row p of N goes to shard p * shards // N. `bytes`: the row whose middle byte is b of B goes to b * shards // B,
    so a shard's bytes are off by its longest rows at most.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    rows = interleaved(docs, seed, whole)
    per = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("size").alias("_b"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    known = per.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(to) for c, to in (("_n", "_rows_before"), ("_b", "_bytes_before"))])
    total = per.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    kept = ["doc_id", "source", "size", "text_crc32", *(["doc"] if whole else [])]
    rows = rows.join(known, F.col("_range") == F.col("_r")).withColumn("_place", F.col("_rows_before") + F.col("_spot"))
    if law == "rows":
        at, first = f"cast(_place * {shards} div {total[0]} as int)", f"(shard * {total[0]} + {shards - 1}) div {shards}"
        rows = rows.withColumn("shard", F.expr(at)).withColumn("_first", F.expr(first))
    else:
        inside = Window.partitionBy("_range").orderBy("_spot").rowsBetween(Window.unboundedPreceding, 0)
        middle = F.col("_bytes_before") + F.sum("size").over(inside) - F.expr("(size + 1) div 2")
        rows = rows.withColumn("_middle", middle).withColumn("shard", F.expr(f"cast(_middle * {shards} div {total[1]} as int)"))
        rows = rows.join(rows.groupBy(F.col("shard").alias("_s")).agg(F.min("_place").alias("_first")), F.col("shard") == F.col("_s"))
    return rows.select(*kept, F.lit(law).alias("law"), "shard", (F.col("_place") - F.col("_first")).cast("long").alias("slot"))


def written_shards(docs: DataFrame, folder: str, shards: int = SHARDS, law: str = "rows", seed: int = SEED) -> None:
    """The whole rows as Parquet, a folder for each shard, in the order of their slots (ranges of slots are files of their own)."""
    rows = sharded(docs, shards, law, seed, whole=True)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("shard", "slot", "doc").write.partitionBy("shard").mode("overwrite").parquet(folder)
