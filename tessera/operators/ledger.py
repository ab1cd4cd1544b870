"""The ledger of everything judged: upserts, decisions, feedback, upkeep, statistics and listings, as rewrites of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import numbered
from tessera.sources import bucketed

JUDGED = ("title", "company", "status", "stage_reached", "reasoning", "run_id")
KEPT = ("user_action", "reason", "decided_at", "review_status")
BULKY = ("reasoning", "evidence", "criteria")
PRUNE_DAYS, WORTH_ASKING = 60, 1_000_000
ACTIONS = ("applied", "skipped_fit", "skipped_other", "expired")


def unseen(postings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Postings whose URL hash is not in the ledger; of the ledger only the hash is read."""
    return postings.withColumn("_h", T.url_hash("job_url")).join(ledger.select(F.col("job_url_hash").alias("_h")), "_h", "left_anti").drop("_h")


def upserted(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The snapshot with a run's results: a row for each URL and each duplicate URL, the last write of a hash wins
    (by ord, and of one ord the greatest row).

    Judgments are overwritten, source keeps its old value where the new one is null, decisions stay untouched.
    """
    rows = results.select("*", F.explode(F.array_union(F.array("job_url"), F.coalesce("duplicate_job_urls", F.array().cast("array<string>")))).alias("url"))
    rows = rows.withColumn("job_url_hash", T.url_hash("url"))
    row = F.struct(F.col("url").alias("job_url"), *JUDGED, "source", "last_seen_at")
    last = rows.groupBy("job_url_hash").agg(F.max_by(row, F.struct(F.col("ord"), row)).alias("x")).select(F.col("job_url_hash").alias("_h"), "x")
    both = ledger.join(last, F.col("job_url_hash") == F.col("_h"), "full")
    new = F.col("x").isNotNull()
    over = [F.when(new, F.col(f"x.{c}")).otherwise(F.col(c)).alias(c) for c in ("job_url", *JUDGED, "last_seen_at")]
    return both.select(F.coalesce("_h", "job_url_hash").alias("job_url_hash"), *over, F.coalesce("x.source", "source").alias("source"), F.when(new, F.lit(None).cast("timestamp")).otherwise(F.col("pruned_at")).alias("pruned_at"), *KEPT)


#: The columns of a ledger that upserts keep.
COLUMNS = ("job_url_hash", "job_url", *JUDGED, "last_seen_at", "source", "pruned_at", *KEPT)


def upserted_buckets(folder: str, results: DataFrame, empty: DataFrame, journal: int | None = None) -> set[int]:
    """upserted() on a ledger in buckets: those of the results' keys are read and written, the others stay as they are."""
    urls = F.array_union(F.array("job_url"), F.coalesce("duplicate_job_urls", F.array().cast("array<string>")))
    keyed = results.select(F.explode(urls).alias("url")).select(T.url_hash("url").alias(bucketed.KEY))
    return bucketed.rewritten(results.sparkSession, folder, keyed, lambda rows: upserted(rows, results).select(*COLUMNS), empty, journal)


def unseen_in(postings: DataFrame, folder: str) -> DataFrame:
    """unseen() against a ledger in buckets that is far larger than the run: filters first, then the keys of likely buckets only."""
    keyed = postings.withColumn("_h", T.url_hash("job_url"))
    known = bucketed.known(keyed.select(F.col("_h").alias(bucketed.KEY)), folder)
    return keyed.join(known, F.col("_h") == F.col(bucketed.KEY), "left_anti").drop("_h")


def decided(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Decisions (job_url, ts, action, reason) folded into the ledger: the last given value of each field; unknown jobs and actions are ignored."""
    known = events.where(F.col("action").isNull() | F.col("action").isin(*ACTIONS))
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"_{c}")
    per = known.groupBy(F.col("job_url").alias("_u")).agg(last("action"), last("reason"), F.max("ts").alias("_ts"))
    df = ledger.join(per, F.col("job_url") == F.col("_u"), "left")
    new = {"user_action": F.coalesce("_action", "user_action"), "reason": F.coalesce("_reason", "reason"), "decided_at": F.coalesce("_ts", "decided_at"), "review_status": F.when(F.col("_u").isNull(), F.col("review_status"))}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in ledger.columns])


def awaiting_review(ledger: DataFrame) -> DataFrame:
    return ledger.where("user_action = 'skipped_fit' and coalesce(reason, '') <> '' and review_status is null")


def reviewed(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """Review marks (job_url, mark: applied or declined) put on the ledger."""
    m = marks.where("mark in ('applied', 'declined')").groupBy(F.col("job_url").alias("_u")).agg(F.max_by("mark", "ts").alias("_m"))
    return ledger.join(m, F.col("job_url") == F.col("_u"), "left").select(*[F.coalesce("_m", c).alias(c) if c == "review_status" else F.col(c) for c in ledger.columns])


def feedback(events: DataFrame, known: DataFrame) -> DataFrame:
    """job_url, criterion_id, comment, at: the last event of each criterion, withdrawn ones and unknown jobs left out."""
    last = events.join(known.select("job_url"), "job_url", "left_semi").groupBy("job_url", "criterion_id").agg(F.max_by(F.struct("vote", T.strip(T.text("comment")).alias("comment"), "ts"), "ts").alias("x"))
    return last.where("x.vote = 'disagree'").select("job_url", "criterion_id", F.nullif(F.col("x.comment"), F.lit("")).alias("comment"), F.col("x.ts").alias("at"))


def feedback_maps(rows: DataFrame) -> DataFrame:
    """job_url, feedback: a map by criterion (a rubric bounds its size)."""
    return rows.groupBy("job_url").agg(F.map_from_entries(F.collect_list(F.struct("criterion_id", F.struct("comment", "at")))).alias("feedback"))


def pending_feedback(rows: DataFrame, criteria: DataFrame, marked: DataFrame) -> DataFrame:
    """Feedback not reviewed yet, with what was judged (label, result, quote, why)."""
    open_ = rows.join(marked.select("job_url", "criterion_id"), ["job_url", "criterion_id"], "left_anti")
    return open_.join(criteria.select("job_url", F.col("id").alias("criterion_id"), "label", "result", "quote", "why"), ["job_url", "criterion_id"], "left")


def stale(now) -> Column:
    return T.older_than(F.col("last_seen_at"), now, PRUNE_DAYS) & (F.coalesce("user_action", F.lit("")) != "applied") & F.col("pruned_at").isNull()


def detailed(columns: tuple[str, ...] = BULKY) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNotNull()
    return out


def pruned(ledger: DataFrame, now, columns: tuple[str, ...] = BULKY) -> DataFrame:
    go = F.coalesce(stale(now) & detailed(columns), F.lit(False))
    new = {c: F.when(~go, F.col(c)) for c in columns} | {"pruned_at": F.when(go, F.lit(now).cast("timestamp")).otherwise(F.col("pruned_at"))}
    return ledger.select(*[new.get(c, F.col(c)).alias(c) for c in ledger.columns])


def prune_preview(ledger: DataFrame, now, columns: tuple[str, ...] = BULKY) -> DataFrame:
    """Rows by status with the bytes that would go, and the first and last date."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return ledger.where(stale(now) & detailed(columns)).groupBy("status").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"), F.min("last_seen_at").alias("oldest"), F.max("last_seen_at").alias("newest"))


def without_run(ledger: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """The ledger without a run, and the rows that go to the trash."""
    return ledger.where(~F.col("run_id").eqNullSafe(F.lit(run_id))), ledger.where(F.col("run_id") == run_id)


def restored(ledger: DataFrame, trash: DataFrame) -> DataFrame:
    """The ledger and the trash rows whose hash was not judged again since."""
    return ledger.unionByName(trash.join(ledger.select("job_url_hash"), "job_url_hash", "left_anti"), allowMissingColumns=True)


def run_previews(ledger: DataFrame) -> DataFrame:
    """Of each run, what deleting it would lose."""
    return ledger.groupBy("run_id").agg(
        F.count("*").alias("jobs"), F.count("user_action").alias("decisions"), F.count_if(F.col("user_action") == "applied").alias("applied"), F.count_if(F.coalesce("reason", F.lit("")) != "").alias("reasons"),
        F.count_if((F.col("user_action") == "skipped_fit") & (F.coalesce("reason", F.lit("")) != "") & F.col("review_status").isNull()).alias("not_reviewed"),
    )


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """An older snapshot and a newer one, with columns the older lacks as null."""
    return new.unionByName(old, allowMissingColumns=True)


def backfilled(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id of rows without one, from the run of the day they were last seen (the first of several)."""
    day = runs.groupBy(F.to_date("started_at").alias("_d")).agg(F.min("run_id").alias("_r"))
    return ledger.join(day, F.to_date("last_seen_at") == F.col("_d"), "left").select(*[F.coalesce("run_id", "_r").alias("run_id") if c == "run_id" else F.col(c) for c in ledger.columns])


def continuable(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, waiting, later: runs with passes that wait, and the stages they may go on to."""
    waiting = outcomes.where("status in ('remote_pass', 'stage1_pass')").groupBy("run_id").agg(F.count("*").alias("waiting"))
    order = F.array(F.lit("remote"), F.lit("stage1"), F.lit("stage2"))
    last = F.array_position(order, F.try_element_at("stages", F.lit(-1)))
    return runs.join(waiting, "run_id").select("run_id", "waiting", F.slice(order, (last + 1).cast("int"), 3).alias("later"))


def keyword_effect(ledger: DataFrame) -> DataFrame:
    """keyword, status, n: how often postings with a keyword ended in each status."""
    return ledger.select("status", F.explode(F.array_distinct("matched_keywords")).alias("keyword")).groupBy("keyword").pivot("status", ["passed", "review", "stage2_fail"]).agg(F.count("keyword")).na.fill(0)


def run_records(results: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Counts of each run by status, and what follows from them; given figures (run_id, stage0_passed) override."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    df = results.groupBy("run_id").agg(F.count("*").alias("total"), n("remote_fail").alias("remote_fail"), n("stage1_fail").alias("stage1_fail"), n("stage1_pass", "remote_pass").alias("stage2_pending"), n("passed").alias("stage2_pass"), n("review").alias("stage2_review"), n("stage2_fail").alias("stage2_fail"))
    df = df.withColumn("stage1_pass", F.col("stage2_pending") + F.col("stage2_pass") + F.col("stage2_review") + F.col("stage2_fail"))
    if given is None:
        return df.withColumn("stage0_passed", F.col("total"))
    return df.join(given.select("run_id", F.col("stage0_passed").alias("_g")), "run_id", "left").withColumn("stage0_passed", F.coalesce("_g", "total")).drop("_g")


def run_summary(results: DataFrame) -> DataFrame:
    """What is said when a run ends: total, passed, review, those that wait for a stage, and Stage-2 jobs without a text (column
    body) to check quotes against."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status = F.col("status")
    unchecked = status.isin("passed", "review", "stage2_fail") & (T.strip(T.text("body")) == "")
    return results.groupBy("run_id").agg(F.count("*").alias("total"), n(status == "passed").alias("passed"), n(status == "review").alias("review"), n(status.isin("stage1_pass", "remote_pass")).alias("stage2_pending"), n(unchecked).alias("quotes_unchecked"))


def tokens_per_run(lines: DataFrame, given: DataFrame) -> DataFrame:
    """run_id, tokens: a given figure that is not 0, else the sum of the readable lines, else null."""
    total = lines.groupBy("run_id").agg(F.sum(F.expr("try_cast(tokens as bigint)")).alias("s"))
    df = given.select("run_id", "given").join(total, "run_id", "full")
    return df.select("run_id", F.nullif(F.coalesce(F.nullif(F.col("given"), F.lit(0)), F.col("s")), F.lit(0)).alias("tokens"))


def tokens_per_thread(events: DataFrame) -> DataFrame:
    """thread_id, tokens: the last running total of the newest log."""
    ok = F.expr("try_cast(total as bigint)")
    return events.groupBy("thread_id").agg(F.max_by(F.when(ok.isNotNull(), ok), F.when(ok.isNotNull(), F.struct("file", "line"))).alias("tokens"))


def thread_sum(threads: DataFrame) -> DataFrame:
    return threads.agg(F.when(F.count_if(F.col("tokens").isNull()) == 0, F.sum("tokens")).alias("tokens"))


def stage_progress(outcomes: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return outcomes.groupBy("run_id", "stage").agg(F.count("*").alias("total"), n("pass"), n("fail"), n("pending"))


def run_durations(runs: DataFrame, now) -> DataFrame:
    """Seconds since a run began or was continued, with what it had taken before."""
    start = F.coalesce("continued_at", "ts_start")
    return runs.select("run_id", (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(start) + F.when(F.col("continued_at").isNotNull(), F.coalesce("previous_seconds", F.lit(0))).otherwise(0)).alias("seconds"))


def result_listing(ledger: DataFrame, status: str | None = None) -> DataFrame:
    """Judged rows of every run, one of each (title, company, reasoning), with their place: passed, review, others, then newest."""
    rows = ledger.where("stage_reached = 2")
    if status:
        rows = rows.where(F.col("status") == status)
    rank = F.when(F.col("status") == "passed", 0).when(F.col("status") == "review", 1).otherwise(2)
    order = [rank, F.desc("last_seen_at"), F.col("job_url_hash")]
    by = Window.partitionBy("run_id", "title", "company", "reasoning")
    first = rows.withColumn("repost_count", F.count("*").over(by)).withColumn("_k", F.row_number().over(by.orderBy(*order))).where("_k = 1").drop("_k")
    return numbered(first, "place", *order, within=("run_id",))


def page(listing: DataFrame, number: int, size: int = 10) -> DataFrame:
    """One page of each run's listing, with total and total_pages; the number is clamped."""
    total = listing.groupBy(F.col("run_id").alias("_r")).agg(F.count("*").alias("total"))
    df = listing.join(total, F.col("run_id").eqNullSafe(F.col("_r"))).drop("_r").withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))
    at = F.least(F.greatest(F.lit(number), F.lit(1)), F.col("total_pages"))
    return df.withColumn("page", at).where((F.col("place") > (F.col("page") - 1) * size) & (F.col("place") <= F.col("page") * size))


def kept_runs(runs: DataFrame, most: int = 4) -> DataFrame:
    """Run files that stay: the newest `most` of each profile (a new run joins them), and those that wait for a stage."""
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("started_at"), "run_id"))
    return runs.withColumn("_p", place).where((F.col("_p") <= most) | F.col("waiting")).drop("_p")


def normal_runs(runs: DataFrame) -> DataFrame:
    """Run records with what old ones lack filled in, and their place, newest first, within a profile."""
    filled = runs.withColumn("stages", F.coalesce("stages", F.array(F.lit("stage1"), F.lit("stage2")))).withColumn("stage0_passed", F.coalesce("stage0_passed", "total")).withColumn("stopped_after", F.coalesce("stopped_after", F.try_element_at("stages", F.lit(-1))))
    return numbered(filled, "place", F.desc("started_at"), F.col("run_id"), within=("profile_id",))


def stage1_listing(ledger: DataFrame, passed: bool) -> DataFrame:
    """Stage-1 fails or passes of each run by title; filler reasons are blank, reposts shown once."""
    rows = ledger.where("stage_reached = 2 or status = 'stage1_pass'" if passed else "status = 'stage1_fail'")
    reason = F.when(F.lower(T.strip(T.text("reasoning"))).isin("", "n/a", "none", "-"), "").otherwise(T.text("reasoning"))
    rows = rows.withColumn("reasoning", reason)
    by = Window.partitionBy("run_id", "title", "company", "reasoning")
    return rows.withColumn("repost_count", F.count("*").over(by)).withColumn("_k", F.row_number().over(by.orderBy("job_url_hash"))).where("_k = 1").drop("_k")


def remote_listing(rows: DataFrame, passed: bool) -> DataFrame:
    """Remote-check fails or passes by title, reposts with equal answers once; the reason falls back to what failed."""
    df = rows.where(F.col("verdict") == ("pass" if passed else "fail")).withColumn("key", F.to_json("answers"))
    said = F.array_join(F.transform(F.filter("answers", lambda a: a["rule"] == "fail"), lambda a: F.concat(a["label"], F.lit(": "), a["answer_label"])), "; ")
    df = df.withColumn("reason", F.coalesce(F.nullif(F.col("reason"), F.lit("")), said))
    by = Window.partitionBy("title", "company", "key")
    return df.withColumn("repost_count", F.count("*").over(by)).withColumn("_k", F.row_number().over(by.orderBy("job_url"))).where("_k = 1").drop("_k", "key")


def trash_listing(trash: DataFrame) -> DataFrame:
    return trash.groupBy("run_id").agg(F.max("deleted_at").alias("deleted_at"), F.count("*").alias("jobs")).orderBy(F.desc("deleted_at"), "run_id")
