import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import boards, judging, ledger, linkage, stage0
from tessera.operators.graph import roots
from tessera.sources import exports, history, landing
from tessera.streaming import jobs


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_roots(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (2, 9)], "a int, b int")
    assert rows(roots(edges), "node", "root") == [(4, 3), (5, 3), (8, 2), (9, 2)]
    assert roots(edges.limit(0)).count() == 0


def test_answers_are_one_whole_object(spark):
    good = '{"verdict": "pass", "reason": "it\\"s {so}"}'
    shapes = {good: True, f"```json\n{good}\n```": True, f" {good}\n": True, '{"verdict": 5, "blocks": "odd"}': True, "{}": True}
    shapes |= dict.fromkeys((f"{good} {good}", f"{good}, {good}", f"{good}] {good}", f"{good}] [{good}", '{"verdict":"pass", bad}', f"[{good}]", f"{good} more", "{'verdict': 'pass'}", "{", "", "null", f"prose {good}"), False)
    df = spark.createDataFrame([(s,) for s in shapes] + [(None,)], "raw string").select("raw", judging.parsed(F.col("raw"), judging.STAGE1).isNotNull().alias("ok"))
    assert {r.raw: r.ok for r in df.collect()} == shapes | {None: False}


def test_merge_and_waterfall(spark):
    data = [(0, 1, "u1", "Senior Product Manager", "A", "x", "We ship prototypes daily in a small team. Fully remote.", "Product Manager"), (1, 2, "u1", "Senior Product Manager", "A", "x", "other", "Product Builder"), (2, 2, "u2", "Builder", "A", "x", "Fluent German is required. We build a prototype with care.", "Product Builder"), (3, 3, "u3", "Lead", "B", "y", "Nothing of interest is written here at all.", "Lead")]
    posts = stage0.merged_searches(spark.createDataFrame(data, "ord long, search_n int, job_url string, title string, company string, location string, description string, term string"))
    assert rows(posts.select("job_url", F.array_join("search_terms", ",").alias("t")), "job_url", "t") == [("u1", "Product Manager,Product Builder"), ("u2", "Product Builder"), ("u3", "Lead")]
    got = stage0.waterfall(posts, ["en"], ["prototype"], ["casino"], ["remote"], terms=["Product Manager", "Lead"])
    assert rows(got, "job_url", "drop_reason") == [("u1", None), ("u2", "language_requirement"), ("u3", "no_tier1_hit")]
    assert rows(stage0.requirement_evidence(got), "evidence") == [("Fluent German is required",)]
    assert rows(got.select("job_url", stage0.title_matches(F.col("title_hits"), F.col("search_terms")).alias("ok")), "job_url", "ok") == [("u1", True), ("u2", False), ("u3", True)]


def test_screened(spark):
    words = "We ship a prototype every week. Fully remote. " + " ".join(f"w{i}" for i in range(30))
    none = "Nothing of interest is written here at all."
    data = [(0, "u0", "Lead", "A", words), (1, "u1", "Lead", "B", words), (2, "u2", "Other", "C", "A prototype of ours, and casino nights. Remote."), (3, "u3", "Builder", "D", "Another prototype that we build. Remote."), (4, "u4", "Lead", "A", none), (5, "u5", "Maker", "E", "This prototype is new. Remote work."), (6, "u5b", "Maker", "e", "This prototype is new. Remote work.")]
    posts = spark.createDataFrame([(*x[:4], "x", x[4]) for x in data], "ord long, job_url string, title string, company string, location string, description string")
    seen = spark.createDataFrame([("u0",), ("u0",), ("u1",), ("u3",), ("u4",)], "job_url string").withColumn("job_url_hash", stage0.T.url_hash("job_url"))
    got = stage0.screened(stage0.waterfall(posts, [], ["prototype"], ["casino"], ["remote"]), seen)
    # u1 is in the ledger too, but stands for the repost that it is; u0 hides it although it has been seen itself.
    assert rows(got, "job_url", "drop_reason") == [("u0", "already_seen"), ("u1", "duplicate_content"), ("u2", "exclude_keyword"), ("u3", "already_seen"), ("u4", "no_tier1_hit"), ("u5", None), ("u5b", "duplicate_content")]
    counts = dict(rows(stage0.drop_counts(got), "outcome", "n"))
    assert set(counts) == {"passed", *stage0.RULES} and sum(counts.values()) == len(data) and counts["duplicate_content"] == 2 and counts["already_seen"] == 2 and counts["language"] == 0


def test_pages_read(spark):
    data = [(1, p, i, f"u{p}-{i}", "hit" if (p, i) == (0, 0) else "no") for p in range(6) for i in range(2)] + [(1, 8, 0, "u", "hit"), (1, 1, 5, "u0-0", "hit")]
    df = spark.createDataFrame(data, "search_n int, page int, pos int, job_url string, title string")
    assert {r["page"] for r in stage0.pages_read(df, F.col("title") == "hit", streak=2).collect()} == {0, 1, 2}
    assert {r["page"] for r in stage0.pages_read(df, F.col("title") == "hit", most=4).collect()} == {0, 1}
    assert {r["page"] for r in stage0.pages_read(df, F.col("title") == "hit").collect()} == set(range(6))


def test_reposts(spark):
    words = " ".join(f"w{i}" for i in range(40))
    data = [(0, "u1", "Sr. PM", "Acme", "Berlin", words, "h"), (1, "u2", "Senior PM", "ACME", "Madrid", words + " more", ""), (2, "u3", "Senior PM", "Acme", "Rome", "quite another text", ""), (3, "u4", "Other", "B", "Berlin", "z", "h"), (4, "u5", "X", "C", None, "", "")]
    df = spark.createDataFrame(data, "ord long, job_url string, title string, company string, location string, description string, content_hash string")
    got = linkage.representatives(df).select("job_url", F.array_join("duplicate_job_urls", ",").alias("d"), F.array_join("duplicate_locations", ",").alias("l"), "merged")
    assert rows(got, "job_url", "d", "l", "merged") == [("u1", "u2,u4", "Madrid", 2), ("u3", None, None, 0), ("u5", None, None, 0)]
    assert linkage.representatives(df.limit(0)).count() == 0


def test_reposts_of_whole_texts(spark, tmp_path):
    """The registered queries tell texts with one opening apart, and titles after their first letters; short copies meet."""
    from tessera.plans import registry

    opening, tail = " ".join(f"open{i}" for i in range(60)), lambda k: " ".join(f"{k}{i}" for i in range(60))
    alike = lambda title: f"{title}\n" + " ".join(f"w{i}" for i in range(100))
    texts = [opening + tail("a"), opening + tail("b"), "Short text", "short  TEXT!", alike("Senior engineer"), alike("Senior plumber"), alike("Senior engineer") + " more", ""]
    docs = spark.createDataFrame([(i, t, "en", "s" if i in (4, 5, 6) else f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(registry.x2_content_hash_edges(spark, str(tmp_path)), "a", "b") == [(2, 3)]
    assert rows(registry.x3_word_edges(spark, str(tmp_path)), "a", "b") == [(4, 6)]
    got = registry.x4_representatives(spark, str(tmp_path))
    assert rows(got, "ord", "merged") == [(0, 0), (1, 0), (2, 1), (4, 1), (5, 0), (7, 0)]


def test_word_edges_brute_force(spark):
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(60):
        t = list(base[: r.randint(10, 30)])
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = f"x{r.randint(0, 9)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame([(i, "t", "c", t) for i, t in enumerate(texts)], "ord long, title string, company string, description string")
    sets = [set(t.split()) for t in texts]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in roots(linkage.word_edges(df)).collect()}
    assert [found.get(i, i) for i in range(60)] == [find(i) for i in range(60)]


def test_boards(spark):
    b = spark.createDataFrame([("lever", "a", 0, "PM (m/w/d)", "text", "u", None), ("lever", "a", 1, "PM", "text", "u2", None), ("lever", "a", 2, "QA", "one", "u", None), ("lever", "a", 3, "QA", "two", "u", None)], "vendor string, slug string, ord int, title string, description string, url string, ref string")
    assert rows(boards.by_title(b), "norm_title", "post.url") == [("pm", "u")]
    watched = spark.createDataFrame([("j1", "ats:lever/a", "PM"), ("j2", "ats:lever/a", "Gone"), ("j3", "ats:lever/none", "PM")], "job_url string, source string, title string")
    assert rows(boards.still_open(watched, b), "job_url", "open") == [("j1", True), ("j2", False), ("j3", None)]
    local = spark.createDataFrame([("acme", None, "2024-01-01"), ("new", "lever", "2024-01-01")], "company_key string, vendor string, checked_at string")
    who = spark.createDataFrame([(0, "Acme GmbH"), (1, "ACME"), (2, "New"), (3, "Fresh")], "ord int, company string")
    assert rows(boards.to_look_up(who, local.limit(0), local, "2024-03-01"), "company_key", "company") == [("acme", "Acme GmbH"), ("fresh", "Fresh")]


def _criteria(spark, data):
    return spark.createDataFrame(data, "job_url string, id string, kind string, grp string, result string")


@pytest.mark.parametrize("data, verdict", [
    ([("p1", "pass", None, "met"), ("f1", "fail", None, "not_applicable")], "pass"), ([("p1", "pass", None, "met"), ("f1", "fail", None, "unclear")], "review"), ([("p1", "pass", None, "met"), ("f1", "fail", None, "triggered")], "fail"),
    ([("p1", "pass", "g", "met"), ("p2", "pass", "g", "not_met")], "fail"), ([("p1", "pass", "g", "met"), ("p2", "pass", "g", "not_met"), ("p3", "pass", None, "unclear")], "review"), ([("f1", "fail", None, "unclear")], "fail"), ([("x", "preference", None, "met")], "fail"),
])
def test_verdicts(spark, data, verdict):
    assert judging.verdicts(_criteria(spark, [("j", *d) for d in data])).first()["verdict"] == verdict


def test_parsed(spark):
    df = spark.createDataFrame([('```json\n{"verdict": "pass"}\n```',), ('{"verdict": "fail"} more',), ("[1]",), (None,)], "raw string")
    assert [r["v"] for r in df.select(judging.parsed(F.col("raw"), judging.STAGE1)["verdict"].alias("v")).collect()] == ["pass", None, None, None]


def test_rubric_excerpt(spark):
    df = spark.createDataFrame([("# R\n## Pass\na\n## Fail\nb\n## Notes\nc",), ("plain",)], "r string")
    assert [x[0] for x in df.select(judging.rubric_excerpt(F.col("r"))).collect()] == ["## Pass\na\n## Fail\nb", "plain"]


def test_history_and_listing(spark):
    old = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], "ord long, run_id string, n int")
    new = spark.createDataFrame([(0, "b", 2), (1, "c", 3)], "ord long, run_id string, n int")
    assert [r["run_id"] + str(r["n"]) for r in history.appended_records(old, new).orderBy("ord").collect()] == ["a1", "b2", "c3"]


def test_landing(spark, tmp_path):
    (tmp_path / "1.json").write_text('[{"job_url": "u1", "title": "a"}, {"title": "no url"}]')
    (tmp_path / "2.json").write_text('[{"job_url": "u2", "title": "b"}]')
    (tmp_path / "2.progress.json").write_text("{}")
    assert rows(landing.landed_searches(spark, str(tmp_path)), "search_n", "job_url") == [(1, "u1"), (2, "u2")]
    xml = "<workzag-jobs><position><id>1</id><name>Dev</name><jobDescriptions><jobDescription><name>Tasks</name><value>&lt;b&gt;Build&lt;/b&gt;</value></jobDescription></jobDescriptions></position></workzag-jobs>"
    feeds = spark.createDataFrame([("personio", "s", 0, xml), ("personio", "s", 1, xml.replace("Dev", "Developer"))], "vendor string, slug string, feed_n int, body string")
    assert rows(landing.position_postings(feeds), "title", "ref") == [("Dev", "1"), ("Developer", "1")]
    body = '{"jobs": [{"title": "T", "content": "&amp;lt;p&amp;gt;Hi&amp;lt;/p&amp;gt;", "absolute_url": "u", "id": "1"}]}'
    assert rows(landing.board_postings(spark.createDataFrame([("greenhouse", "g", body), ("greenhouse", "h", "oops"), ("ashby", "x", None)], "vendor string, slug string, body string")), "slug", "title", "description") == [("g", "T", "Hi")]


def test_streams(spark, tmp_path):
    ev = str(tmp_path / "ev")
    spark.createDataFrame([("r", "stage1", "pass", "5"), ("r", "stage1", "pass", "x"), ("r", "stage1", "fail", "7")], "run_id string, stage string, outcome string, tokens string").write.parquet(ev)
    schema = "run_id string, stage string, outcome string, tokens string"
    for name, df, mode, want in (("counts", jobs.live_counts(jobs.arrivals(spark, ev, schema)), "complete", [("r", "stage1", "fail", 1), ("r", "stage1", "pass", 2)]), ("tokens", jobs.token_totals(jobs.arrivals(spark, ev, schema)), "complete", [("r", 12)])):
        jobs.drained(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)))
        assert sorted(tuple(r) for r in spark.table(name).collect()) == want


def test_report_and_ages(spark, tmp_path):
    df = spark.createDataFrame([("r1", "passed", 0, "T", "C", "u", "why", ["q"]), ("r1", "stage2_fail", 1, "T", "C", "u", "", [])], "run_id string, status string, ord int, title string, company string, job_url string, reasoning string, evidence array<string>")
    lines = exports.digest_lines(df)
    assert rows(lines, "block") == [("## T — C\nu\nwhy\n> q",)]
    exports.write_report(lines, "block", str(tmp_path / "r"))
    assert (tmp_path / "r" / "run_id=r1").exists()
    runs = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), None, None)], "run_id string, ts_start timestamp, continued_at timestamp, previous_seconds long")
    assert rows(ledger.run_durations(runs, "2024-01-01 00:01:00"), "seconds") == [(60,)]


def hot_key(spark, sets):
    """Postings of one company and title with the given word sets."""
    return spark.createDataFrame([(i, "Acme", "Lead", " ".join(sorted(s))) for i, s in enumerate(sets)], "ord long, company string, title string, description string")


def nodes(spark, sets):
    return spark.createDataFrame([("k", i, sorted(s), len(s)) for i, s in enumerate(sets)], "k string, a long, w array<string>, n int")


@pytest.mark.parametrize("most", [2, 200])
@pytest.mark.parametrize("words", [12, 60, 400])
def test_word_edges_against_all_pairs(spark, most, words, monkeypatch):
    rng, sets = random.Random(words), set()
    for _ in range(40):
        base = {f"w{rng.randrange(words)}" for _ in range(rng.randrange(1, 50))}
        for _ in range(4):
            sets.add(frozenset(base))
            base = base ^ {f"w{rng.randrange(words)}" for _ in range(rng.randrange(1, 4))} or {"w"}
    sets = sorted(sets, key=sorted)
    wanted = {(i, j) for i, x in enumerate(sets) for j in range(i + 1, len(sets)) if 100 * len(x & sets[j]) >= 85 * len(x | sets[j])}
    assert wanted
    assert wanted <= set(rows(linkage.candidates(nodes(spark, sets), most), "a", "b"))
    monkeypatch.setattr(linkage, "LISTED", most)
    assert set(rows(linkage.word_edges(hot_key(spark, sets)), "a", "b")) == wanted


def test_word_edges_of_a_hot_key(spark):
    """20,000 different texts of one company and title, all with the same 45 words and five to seven of their own: as many candidates as links, about."""
    same = {f"s{i}" for i in range(45)}
    sets = [same | {f"u{i}_{j}" for j in range(5 + i % 3)} for i in range(20_000)]
    sets += [sets[i] | {"more"} for i in range(0, 3_000, 10)]
    found = linkage.candidates(nodes(spark, sets))
    n = found.count()
    assert 300 <= n <= 600
    assert {(10 * i, 20_000 + i) for i in range(300)} <= set(rows(found, "a", "b"))


def test_groups_of_ten_batches_are_those_of_one_run(spark, tmp_path):
    rng = random.Random(3)
    nodes, edges = list(range(120)), [tuple(sorted(rng.sample(range(120), 2))) for _ in range(75)]
    batch = {n: rng.randrange(10) for n in nodes}
    whole = dict(rows(roots(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    folder, touched = str(tmp_path / "g"), []
    for k in range(10):
        ends = spark.createDataFrame([(n,) for n in nodes if batch[n] == k], "node long")
        new = spark.createDataFrame([e for e in edges if max(batch[e[0]], batch[e[1]]) == k], "a long, b long")
        touched.append(linkage.grown_groups(folder, ends, new))
        if k == 9:  # once more: nothing changes
            linkage.grown_groups(folder, ends, new)
    assert rows(linkage.bucketed.snapshot(spark, folder), "node", "root") == sorted((n, whole.get(n, n)) for n in nodes)
    assert all(len(t) < 64 for t in touched)
