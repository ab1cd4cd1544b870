"""Connected components by star contraction, numbering by ranges, and lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not told and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return told or tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder, and read from there from now on."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """The rows with a number from 1 in the given order (of each group), counted by ranges: no task sorts all rows or a hot group."""
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in within], *order).withColumn("_range", F.spark_partition_id()))  # written: ranges are sampled anew each time
    per = ranged.groupBy(*within, "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = per.select(*[F.col(c).alias(f"_g_{c}") for c in within], F.col("_range").alias("_q"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_q")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    place = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(start, same).select(*df.columns, (F.col("_start") + F.col("_place")).alias(name))


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of an undirected graph with columns a and b.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest; stars keep the number of
    rounds near the logarithm of the longest path. Only minima are aggregated, so a hot node is no hot task.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")).select(F.col("u").alias("w"), "m")
        big = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        links = cut(big.join(low, F.col("u") == F.col("w")).select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
