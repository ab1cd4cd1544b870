"""The ledger in buckets and the streams that write to it: what is touched, reruns, restarts, order and bounded state."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import judging, ledger
from tessera.sources import bucketed
from tessera.streaming import jobs

RESULT = "job_url string, duplicate_job_urls array<string>, title string, company string, status string, stage_reached int, reasoning string, run_id string, source string, last_seen_at timestamp, ord long"
T0 = dt.datetime(2024, 1, 1)


def results(spark, urls, status, run="r", more=()):
    return spark.createDataFrame([(u, list(more), "t", "c", status, 2, "why", run, None, T0, i) for i, u in enumerate(urls)], RESULT)


@pytest.fixture
def none(spark):
    columns = [F.lit(None).cast({"stage_reached": "int", "last_seen_at": "timestamp", "pruned_at": "timestamp", "decided_at": "timestamp"}.get(c, "string")).alias(c) for c in ledger.COLUMNS]
    return spark.range(0).select(*columns)


def state(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_upserts_touch_their_buckets(spark, none, tmp_path):
    folder = str(tmp_path / "l")
    first = results(spark, [f"u{i}" for i in range(200)], "passed")
    assert ledger.upserted_buckets(folder, first, none) == {r.bucket for r in bucketed.manifest(spark, folder) if r["keys"]}
    whole = ledger.upserted(none, first)
    assert state(bucketed.snapshot(spark, folder), "job_url", "status") == state(whole, "job_url", "status")
    run = results(spark, ["u7", "new"], "review", more=["copy"])
    touched = ledger.upserted_buckets(folder, run, none, journal=3)
    assert 1 <= len(touched) <= 3
    # what the second write read and wrote: its own buckets only
    assert {int(p.name.partition("=")[2]) for p in (tmp_path / "l/data/version=1").glob("bucket=*")} == touched
    read = bucketed.snapshot(spark, folder, touched).inputFiles()
    assert read and all("/version=1/" in p and int(p.partition("bucket=")[2].partition("/")[0]) in touched for p in read)
    whole = ledger.upserted(whole, run)
    assert state(bucketed.snapshot(spark, folder), *ledger.COLUMNS) == state(whole, *ledger.COLUMNS)
    # the same batch again does nothing; a write that was interrupted before its manifest gives the same snapshot when it is run again
    assert ledger.upserted_buckets(folder, run, none, journal=3) == set()
    shutil.rmtree(f"{folder}/manifest/version=1")
    assert len(bucketed.snapshot(spark, folder).where("job_url = 'new'").collect()) == 0
    assert ledger.upserted_buckets(folder, run, none, journal=3) == touched
    assert state(bucketed.snapshot(spark, folder), *ledger.COLUMNS) == state(whole, *ledger.COLUMNS)
    replaced = {b for b in touched if os.path.isdir(f"{folder}/data/version=0/bucket={b}")}
    assert replaced and bucketed.expired(spark, folder) == len(replaced)
    assert state(bucketed.snapshot(spark, folder), *ledger.COLUMNS) == state(whole, *ledger.COLUMNS)


def test_columns_that_older_writes_lack(spark, tmp_path):
    folder = str(tmp_path / "l")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "job_url_hash string, x int")
    bucketed.created(old, folder, buckets=4)
    wide = spark.createDataFrame([], "job_url_hash string, x int, y string")
    add = spark.createDataFrame([("b", 3, "new"), ("c", 4, "new")], "job_url_hash string, x int, y string")
    bucketed.rewritten(spark, folder, add, lambda rows: rows.join(add.select("job_url_hash"), "job_url_hash", "left_anti").unionByName(add), wide)
    assert sorted(bucketed.snapshot(spark, folder).select("job_url_hash", "x", "y").collect()) == [("a", 1, None), ("b", 3, "new"), ("c", 4, "new")]
    # a write that empties its buckets
    bucketed.rewritten(spark, folder, add, lambda rows: rows.where("false"), wide)
    assert {r.job_url_hash for r in bucketed.snapshot(spark, folder).collect()} <= {"a"}


def test_filters_before_the_exact_look_up(spark, none, tmp_path):
    folder = str(tmp_path / "l")
    assert bucketed.snapshot(spark, folder) is None
    urls = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("job_url"), F.col("id").alias("ord"))
    asked = spark.range(4000, 9000).select(F.concat(F.lit("u"), "id").alias("job_url"), "id").unionByName(spark.createDataFrame([(None, -1), ("u1", -2), ("u1", -3)], "job_url string, id long"))
    assert ledger.unseen_in(asked, folder).count() == 5003  # no ledger yet
    bucketed.created(urls.select(T.url_hash("job_url").alias("job_url_hash"), "job_url", "ord"), folder, buckets=16)
    likely = bucketed.perhaps_known(asked.select(T.url_hash("job_url").alias("job_url_hash")), folder)
    assert 1001 <= likely.count() <= 1001 + 0.03 * 4000
    got = {r.id for r in ledger.unseen_in(asked, folder).collect()}
    assert got == {*range(5000, 9000), -1}
    only_new = spark.createDataFrame([(f"x{i}",) for i in range(30)], "job_url string")
    assert ledger.unseen_in(only_new, folder).count() == 30


# -- streams


def put(spark, folder, rows, schema):
    """One file more, which is one batch more."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_new_postings_have_bounded_state(spark, none, tmp_path, monkeypatch):
    src, out, folder, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "l"), "job_url string, ts timestamp, ok boolean"
    ledger.upserted_buckets(folder, results(spark, [f"seen{i}" for i in range(300)], "passed"), none)
    read = []
    before = bucketed.snapshot
    monkeypatch.setattr(bucketed, "snapshot", lambda s, f, only=None, columns=None: read.append((only, columns)) or before(s, f, only, columns))
    rows = {}

    def go():
        job = jobs.new_postings(stream(spark, src, schema), lambda batch: ledger.unseen_in(batch, folder), lambda df: df.where("ok").select("job_url", "ts"), out, str(tmp_path / "c"), "10 minutes")
        query = jobs.drained(job)
        for p in query.recentProgress:
            if p.stateOperators:
                rows[p.batchId] = p.stateOperators[0].numRowsTotal

    for k in range(8):
        put(spark, src, [(f"n{k}-{i}", at(60 * k), True) for i in range(20)] + [(f"n{k}-0", at(60 * k + 1), True), ("seen5", at(60 * k), True), (f"bad{k}", at(60 * k), False)], schema)
        if k in (3, 7):
            go()  # a restart goes on from the checkpoint
    got = [r.job_url for r in spark.read.schema("job_url string").parquet(out).collect()]
    assert sorted(got) == sorted(f"n{k}-{i}" for k in range(8) for i in range(20))
    assert max(rows.values()) <= 4 * 21  # the last hours' of 168 URLs: as many after eight batches as after two
    assert read and all(columns == ["job_url_hash"] and only is not None and len(only) <= 8 for only, columns in read)


def test_numbers_of_prompts_never_change(spark, tmp_path):
    src, folder, schema = str(tmp_path / "in"), str(tmp_path / "p"), "run_id string, job_url string, ord int, ts timestamp"

    def go():
        jobs.drained(jobs.new_prompts(spark, stream(spark, src, schema), folder, str(tmp_path / "c"), "1 day"))
        return {(r.run_id, r.job_url): r.n for r in spark.read.schema("run_id string, job_url string, n long").parquet(f"{folder}/prompts").collect()}

    put(spark, src, [("r", "b", 2, T0), ("r", "a", 1, T0), ("q", "x", 1, T0), ("r", "a", 1, T0)], schema)
    put(spark, src, [("r", "c", 1, T0), ("r", "b", 2, T0)], schema)
    first = go()
    assert first == {("r", "a"): 0, ("r", "b"): 1, ("q", "x"): 0, ("r", "c"): 2}
    put(spark, src, [("r", "d", 0, T0), ("s", "y", 0, T0), ("q", "w", 0, T0)], schema)
    shutil.rmtree(f"{folder}/prompts/batch=0")  # a restart reads no prompts
    second = go()
    assert second == {("r", "c"): 2, ("r", "d"): 3, ("s", "y"): 0, ("q", "w"): 1}
    assert {r.run_id: r.last for r in spark.read.parquet(f"{folder}/last/batch=2").collect()} == {"r": 3, "q": 1, "s": 0}


def test_prompts_of_passes_before_the_first_watermark(spark, tmp_path):
    src, folder, schema = str(tmp_path / "in"), str(tmp_path / "p"), "run_id string, job_url string, ord int, ts timestamp"

    def go():
        jobs.drained(jobs.new_prompts(spark, stream(spark, src, schema), folder, str(tmp_path / "c"), "1 day"))
        return {(r.run_id, r.job_url): r.n for r in spark.read.schema("run_id string, job_url string, n long").parquet(f"{folder}/prompts").collect()}

    put(spark, src, [("r", "b", None, dt.datetime(1970, 1, 1)), ("r", "a", 1, dt.datetime(1969, 12, 30)), ("r", "a", 1, dt.datetime(1969, 12, 30)), (None, "x", 1, dt.datetime(1970, 1, 1))], schema)
    first = go()
    assert first == {("r", "a"): 0, ("r", "b"): 1, (None, "x"): 0}
    put(spark, src, [("r", "c", 0, dt.datetime(1970, 1, 1)), (None, "y", 1, dt.datetime(1970, 1, 2))], schema)
    assert go() == first | {("r", "c"): 2, (None, "y"): 1}


RUBRIC = [(0, "c1", "pass", "first", None), (1, "c2", "fail", "second", None)]


def answer(result, quote="made by hand"):
    return '{"criteria": [{"id": "c1", "result": "%s", "quote": "%s", "why": "w"}, {"id": "c2", "result": "not_applicable"}]}' % (result, quote)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_answers_in_any_order(spark, none, tmp_path, order):
    rubric = spark.createDataFrame(RUBRIC, "ord int, id string, kind string, label string, grp string")
    asked = [("r", "stage2", n, at(n), f"u{n}", "T", "C", "x", "All of it is made by hand.") for n in range(5)]
    prompts = spark.createDataFrame(asked, "run_id string, stage string, n int, asked_at timestamp, job_url string, title string, company string, location string, description string")
    schema = "run_id string, stage string, n int, raw string, landed_at timestamp"
    broken = answer("met") + " " + answer("met")
    batches = [
        [("r", "stage2", 0, answer("met"), at(10)), ("r", "stage2", 1, broken, at(10)), ("r", "stage2", 9, answer("met"), at(10))],
        [("r", "stage2", 0, answer("not_met"), at(5)), ("r", "stage2", 2, answer("met", "not there"), at(11)), ("r", "stage2", 3, broken, at(12))],
        [("r", "stage2", 1, answer("not_met"), at(12)), ("r", "stage2", 2, answer("met"), at(9))],
    ]
    src, folder = str(tmp_path / "in"), str(tmp_path / "l")
    ledger.upserted_buckets(folder, results(spark, ["u0", "old"], "review"), none)
    readable = judging.parsed(F.col("raw"), judging.STAGE2).isNotNull()
    written = []

    def upsert(rows, number):
        for _ in range(2):  # every batch is written twice
            written.append(ledger.upserted_buckets(folder, rows, none, number))

    for k in order:
        put(spark, src, batches[k], schema)
        jobs.drained(jobs.landed_judgments(stream(spark, src, schema), prompts, readable, lambda rows: judging.judged_answers(rows, prompts, rubric), upsert, str(tmp_path / "c"), "2 days"))
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    batch = ledger.upserted(ledger.upserted(none, results(spark, ["u0", "old"], "review")), judging.judged_answers(every, prompts, rubric))
    got = state(bucketed.snapshot(spark, folder), "job_url", "status", "reasoning", "run_id")
    assert got == state(batch, "job_url", "status", "reasoning", "run_id")
    assert {u: s for u, s, *_ in got} == {"u0": "passed", "old": "review", "u1": "stage2_fail", "u2": "review"}
    assert all(not again for again in written[1::2])
    waiting = judging.pending(prompts.select("run_id", "stage", "n"), every.withColumn("parsed", judging.parsed(F.col("raw"), judging.STAGE2)))
    assert sorted(r.n for r in waiting.collect()) == [3, 4]
