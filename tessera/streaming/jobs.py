"""The incremental jobs as Structured Streaming queries; each batch writes where a rerun of it would write again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tessera.operators.graph import cut, numbered


def arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def new_postings(stream: DataFrame, unseen: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, late: str) -> DataStreamWriter:
    """Postings once for each URL, filtered and not in the ledger, appended batch by batch.

    keep: the rules that look at one posting (Stage 0), within the stream, so that only what passes becomes state. URLs
    are state until the event time (column ts) is `late` behind the watermark. unseen: the look-up in the ledger, such as
    ledger.unseen_in(), which reads filters and the keys of a few buckets for each batch.
    """
    once = keep(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_url"])

    def write(batch: DataFrame, number: int) -> None:
        unseen(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_counts(stream: DataFrame) -> DataFrame:
    """run_id, stage, outcome, n while a run is in progress."""
    return stream.groupBy("run_id", "stage", "outcome").agg(F.count("*").alias("n"))


def token_totals(stream: DataFrame) -> DataFrame:
    return stream.groupBy("run_id").agg(F.sum(F.expr("try_cast(tokens as bigint)")).alias("tokens"))


def new_prompts(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str, late: str | None) -> DataStreamWriter:
    """Prompts of new passes (run_id, job_url, ord, ts), numbered within their run after those of earlier batches; a number never changes.

    late: how far a pass may be behind the newest one (by ts); up to there, one that comes again is no new one. None:
    every row is a pass of its own, and needs no ts. A time up to 1970 counts as the first one behind it, since a
    watermark that has not moved yet stands there and would drop the row as late.

    What a batch has to know of the others is the last number of each run. It is written beside each batch's prompts,
    <folder>/last/batch=<b>, a row for each run, and read from there by the next one: a restart goes on from it, a
    batch that is run again gets the same numbers, and the prompts themselves are never read again. Within a batch
    numbers are counted by ranges, so a run with most of the rows is no hot key, as it would be for a state by run.
    """
    once, schema = stream, "run_id string, last long"
    if late is not None:
        first = F.timestamp_millis(F.lit(1))
        once = stream.withColumn("ts", F.when(F.col("ts") < first, first).otherwise(F.col("ts"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "job_url"])

    def write(batch: DataFrame, number: int) -> None:
        last = spark.read.schema(schema).parquet(f"{folder}/last/batch={number - 1}") if number else spark.createDataFrame([], schema)
        last = last.select(F.col("run_id").alias("_r"), "last")
        placed = numbered(batch.select("run_id", "job_url", "ord"), "_n", F.col("ord").asc_nulls_last(), F.col("job_url").asc_nulls_last(), within=("run_id",))
        rows = placed.join(last, F.col("run_id").eqNullSafe(F.col("_r")), "left").withColumn("n", F.coalesce("last", F.lit(-1)) + F.col("_n")).select("run_id", "job_url", "n")
        rows = cut(rows)
        rows.write.mode("overwrite").parquet(f"{folder}/prompts/batch={number}")
        now = rows.groupBy("run_id").agg(F.max("n").alias("last")).unionByName(last.withColumnRenamed("_r", "run_id"))
        now.groupBy("run_id").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{folder}/last/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def landed_judgments(stream: DataFrame, prompts: DataFrame, readable: Column, judge: Callable[[DataFrame], DataFrame], upsert: Callable[[DataFrame, int], object], checkpoint: str, wait: str) -> DataStreamWriter:
    """Answers (run_id, stage, n, raw, landed_at) judged as they land, in any order, and put into the ledger.

    prompts: run_id, stage, n and asked_at. The state is a row for each prompt that has had an
    answer: its last readable one so far (by landed_at), if any; the others are pending. A prompt's state, and with it
    its chance of a further answer, ends `wait` behind the newest prompt that was answered. judge() gets the
    answers (run_id, stage, n, raw, landed_at) that are new in a batch; upsert(results, batch) has to ignore a batch that it had before,
    as ledger.upserted_buckets() does with its journal.
    """
    key = ["run_id", "stage", "n"]
    asked = stream.join(prompts.select(*[F.col(c).alias(f"_{c}") for c in key], "asked_at"), [F.col(c) == F.col(f"_{c}") for c in key]).drop(*[f"_{c}" for c in key])
    best = F.max(F.when(readable, F.struct("landed_at", "raw"))).alias("best")
    state = asked.withWatermark("asked_at", wait).groupBy(F.window("asked_at", "1 hour"), *key).agg(best, F.count("*").alias("answers"))

    def write(batch: DataFrame, number: int) -> None:
        upsert(judge(batch.where("best is not null").select(*key, "best.raw", "best.landed_at")), number)

    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def drained(writer: DataStreamWriter) -> StreamingQuery:
    """Run what is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
