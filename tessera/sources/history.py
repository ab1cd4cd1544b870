"""Run history and ledger snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def appended_records(history: DataFrame, new: DataFrame) -> DataFrame:
    """History (ord, run_id, ...) with new records: one with a known run_id takes its place, the others follow."""
    top = history.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_top"))
    old = history.select(F.col("run_id").alias("_r"), F.col("ord").alias("_o"))
    fresh = new.join(old, F.col("run_id") == F.col("_r"), "left").join(F.broadcast(top))
    fresh = fresh.withColumn("ord", F.coalesce("_o", F.col("_top") + 1 + F.col("ord"))).select(*history.columns)
    return history.join(new.select("run_id"), "run_id", "left_anti").select(*history.columns).unionByName(fresh)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot; parts written by an older version lack columns, which are null."""
    return spark.read.option("mergeSchema", True).parquet(folder)


def write_ledger(ledger: DataFrame, folder: str, snapshot: str) -> str:
    """A new snapshot folder; the old one stays until readers have moved on."""
    path = f"{folder}/snapshot={snapshot}"
    ledger.write.mode("overwrite").parquet(path)
    return path
