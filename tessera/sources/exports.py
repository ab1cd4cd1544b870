"""Reports and tables that people read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def digest_lines(rows: DataFrame) -> DataFrame:
    """run_id, section, ord, block: passed jobs, then Remote-check passes, then those to review, a text block each.

    Blocks are rows in order, not one string of a run, so that a run of any size is written in parallel.
    """
    section = F.when(F.col("status") == "passed", 0).when(F.col("status") == "remote_pass", 1).when(F.col("status") == "review", 2)
    head = F.concat(F.lit("## "), "title", F.lit(" — "), "company")
    quotes = F.array_join(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda q: F.concat(F.lit("> "), q)), "\n")
    body = F.array_join(F.filter(F.array(head, F.col("job_url"), T.text("reasoning"), quotes), lambda x: x != ""), "\n")
    return rows.withColumn("section", section).where("section is not null").select("run_id", "section", "ord", body.alias("block"))


def rejected_lines(results: DataFrame, dropped: DataFrame) -> DataFrame:
    """Stage fails with their reason, then Stage-0 language drops with the sentence that triggered each."""
    line = F.concat("title", F.lit(" — "), "company", F.lit(": "), F.coalesce(F.nullif(F.col("reasoning"), F.lit("")), F.col("status")))
    fails = results.where(F.col("status").endswith("_fail")).select("run_id", F.lit(0).alias("section"), "ord", line.alias("line"))
    drops = dropped.select("run_id", F.lit(1).alias("section"), "ord", F.concat("title", F.lit(" — "), "company", F.lit(': "'), "evidence", F.lit('"')).alias("line"))
    return fails.unionByName(drops)


def write_report(lines: DataFrame, column: str, folder: str) -> None:
    """A folder of text for each run; a long report is several files, in order."""
    lines.repartitionByRange("run_id", "section", "ord").sortWithinPartitions("run_id", "section", "ord").select("run_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("run_id").text(folder)


def remote_table(answers: DataFrame, labels: list[str]) -> DataFrame:
    """One row of each posting with a pair of columns for each category label, and its evidence sentences, distinct in order."""
    rows = answers.select("job_url", F.inline("answers"))
    wide = rows.groupBy("job_url").pivot("label", labels).agg(F.first("answer_label").alias("answer"), F.first("detail").alias("details"))
    quotes = answers.select(F.col("job_url").alias("_u"), F.array_join(F.array_distinct("evidence"), " | ").alias("evidence"))
    return wide.join(quotes, F.col("job_url") == F.col("_u"), "left").drop("_u")
