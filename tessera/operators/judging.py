"""Prompts out, answers in: problems, evidence checks, outcomes, verdicts and the rows of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import cut, numbered

# What an answer may say, what is said of a posting, and how answers are laid out.
UNKNOWN = "?"
NO_KEYWORD = "No remote keyword in the posting, so nothing says it is remote."
NO_EVIDENCE = "Read as acceptable, but pointed at no sentence that says so."
STATUS = {"pass": "passed", "review": "review", "fail": "stage2_fail"}
NOTES = 3
CRITERION = "struct<id:string,result:string,quote:string,why:string>"
STAGE2 = f"company_line string, criteria array<{CRITERION}>, employer_requirements array<struct<kind:string,label:string,quote:string,candidate:string,why:string>>, notes array<struct<text:string,quote:string>>"
STAGE1 = "verdict string, reason string, evidence_sids array<string>, readings map<string,string>"
REMOTE = "verdict string, reason string, evidence_sids array<string>, answers array<struct<id:string,answer:string,detail:string,evidence_sids:array<string>>>"


def parsed(raw: Column, schema: str) -> Column:
    """A whole-text JSON answer, with or without a code fence; null unless it is one whole object and nothing else.

    from_json reads the first value of a text and passes over what follows, and gives a struct of nulls for a broken
    one. So the text is first read as the first entry of a list that ends with the text's own digest: a broken object
    breaks the list, and a second value or an early end moves the digest from its place.
    """
    bare = T.strip(F.regexp_replace(T.strip(T.text(raw)), "^```(?:json)?\\s*|\\s*```$", ""))
    digest = F.sha1(bare)
    both = F.from_json(F.concat(F.lit("["), bare, F.lit(',"'), digest, F.lit('"]')), "array<string>", {"allowSingleQuotes": "false"})
    whole = bare.startswith("{") & (F.size(both) == 2) & (F.get(both, F.lit(1)) == digest)
    return F.when(whole, F.from_json(bare, schema, {"mode": "PERMISSIVE"}))


def merged_criteria(judged: DataFrame, rubric: DataFrame) -> DataFrame:
    """One row for each job and criterion of the rubric, in its order: the first answer of an id, quotes checked.

    judged: job_url, body (the text quotes are held against, null if none) and results (array of CRITERION).
    rubric: ord, id, kind, label, text, grp; a small table. A deciding result without a quote that is in the text
    becomes unclear (downgraded_from tells what it was).
    """
    jobs = judged.select("job_url", (T.text("body") != "").alias("_said"), T.quote_form("body").alias("_hay"), "results")  # formed once for all criteria
    df = jobs.join(F.broadcast(rubric) if rubric.count() <= 10_000 else rubric, F.lit(True))
    first = F.get(F.filter(F.coalesce("results", F.array().cast(f"array<{CRITERION}>")), lambda r: r["id"] == F.col("id")), F.lit(0))
    df = df.withColumn("_r", first)
    given = F.replace(F.lower(T.strip(T.text("_r.result"))), F.lit(" "), F.lit("_"))
    allowed = F.when(F.col("kind") == "pass", given.isin("met", "unclear", "not_met")).when(F.col("kind") == "fail", given.isin("triggered", "unclear", "not_applicable")).otherwise(given.isin("met", "unclear", "not_met", "not_applicable"))
    df = df.withColumn("_ok", F.col("_r").isNotNull() & allowed).withColumn("_given", F.when(F.col("_ok"), given).otherwise("unclear"))
    df = df.withColumn("quote", F.nullif(T.strip(T.text("_r.quote")), F.lit("")))
    df = df.withColumn("quote_verified", F.when(F.col("_r").isNotNull() & F.col("quote").isNotNull() & F.col("_said"), T.quote_in_form("quote", F.col("_hay"))))
    needs = ((F.col("kind") == "pass") & (F.col("_given") == "met")) | ((F.col("kind") == "fail") & (F.col("_given") == "triggered"))
    weak = needs & (F.col("quote").isNull() | (F.col("quote_verified") == F.lit(False)))
    why = T.strip(T.text("_r.why"))
    df = df.withColumn("downgraded_from", F.when(F.coalesce(weak, F.lit(False)), F.col("_given"))).withColumn("result", F.when(F.coalesce(weak, F.lit(False)), "unclear").otherwise(F.col("_given")))
    df = df.withColumn("why", F.when(F.col("_r").isNull() | (~F.col("_ok") & (why == "")), "Not judged.").otherwise(why))
    return df.select("job_url", "ord", "id", "kind", "label", "grp", "result", "quote", "quote_verified", "downgraded_from", "why")


def verdicts(criteria: DataFrame) -> DataFrame:
    """job_url, verdict of rows (job_url, id, kind, grp, result): two levels of partial aggregates, no lists.

    Fail if a fail criterion is triggered or no pass group is still open; pass if some group is all met and no fail
    criterion is unclear; review otherwise. An ungrouped pass criterion is a group of its own.
    """
    group = F.when(F.col("kind") == "pass", F.coalesce(F.nullif(F.col("grp"), F.lit("")), F.concat(F.lit("\u0000"), "id")))
    per = criteria.withColumn("_g", group).groupBy("job_url", "_g").agg(
        F.bool_and(F.col("result") == "met").alias("met"),
        F.bool_and(F.col("result") != "not_met").alias("open"),
        F.bool_or((F.col("kind") == "fail") & (F.col("result") == "triggered")).alias("hit"),
        F.bool_or((F.col("kind") == "fail") & (F.col("result") == "unclear")).alias("unclear"),
    )
    is_group = F.col("_g").isNotNull()
    jobs = per.groupBy("job_url").agg(F.bool_or(is_group & F.col("met")).alias("met"), F.bool_or(is_group & F.col("open")).alias("open"), F.bool_or("hit").alias("hit"), F.bool_or("unclear").alias("unclear"))
    return jobs.select("job_url", F.when(F.col("hit") | ~F.col("open"), "fail").when(F.col("met") & ~F.col("unclear"), "pass").otherwise("review").alias("verdict"))


def stage2_results(criteria: DataFrame) -> DataFrame:
    """job_url, verdict, status, reasoning (deciding criteria in order), evidence (distinct quotes not refuted)."""
    deciding = ((F.col("kind") == "fail") & F.col("result").isin("triggered", "unclear")) | ((F.col("kind") == "pass") & F.col("result").isin("met", "unclear"))
    line = F.concat("label", F.lit(": "), F.replace("result", F.lit("_"), F.lit(" ")), F.when(F.col("why") != "", F.concat(F.lit(" — "), "why")).otherwise(""))
    # A job has one row of each criterion of the rubric, so these lists are as long as the rubric.
    per = criteria.groupBy("job_url").agg(F.array_sort(F.collect_list(F.when(deciding, F.struct("ord", line.alias("x"))))).alias("l"), F.array_sort(F.collect_list(F.when(F.col("quote").isNotNull() & ~F.coalesce(~F.col("quote_verified"), F.lit(False)), F.struct("ord", F.col("quote").alias("x"))))).alias("q"), F.bool_or((F.col("kind") == "fail") & (F.col("result") == "triggered")).alias("hit"))
    df = verdicts(criteria).join(per, "job_url")
    lines = F.transform("l", lambda x: x["x"])
    lines = F.when((F.col("verdict") == "fail") & ~F.col("hit"), F.concat(lines, F.array(F.lit("No pass criterion can be met.")))).otherwise(lines)
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return df.select("job_url", "verdict", status[F.col("verdict")].alias("status"), F.array_join(lines, " | ").alias("reasoning"), F.array_distinct(F.transform("q", lambda x: x["x"])).alias("evidence"))


def extras(answer: Column, body: Column) -> Column:
    """company_line, employer, notes of a Stage-2 answer; what claims a quote that is not in the text goes."""
    quote = lambda x: F.nullif(T.strip(T.text(x["quote"])), F.lit(""))
    true = lambda x: quote(x).isNull() | (T.text(body) == "") | T.quote_in_text(quote(x), body)
    low = lambda x: F.lower(T.strip(T.text(x)))
    asks = F.filter(answer["employer_requirements"], lambda x: (T.strip(T.text(x["label"])) != "") & quote(x).isNotNull() & true(x))
    asks = F.transform(asks, lambda x: F.struct(F.when(x["kind"].isin("must", "preferred"), x["kind"]).otherwise("preferred").alias("kind"), T.strip(x["label"]).alias("label"), quote(x).alias("quote"), F.when(low(x["candidate"]).isin("meets", "unclear", "gap"), low(x["candidate"])).otherwise("unclear").alias("candidate"), T.strip(T.text(x["why"])).alias("why")))
    notes = F.filter(answer["notes"], lambda x: (T.strip(T.text(x["text"])) != "") & true(x))
    notes = F.slice(F.transform(notes, lambda x: F.struct(T.strip(x["text"]).alias("text"), quote(x).alias("quote"))), 1, NOTES)
    line = F.nullif(T.strip(F.regexp_replace(T.text(answer["company_line"]), "\\s+", " ")), F.lit(""))
    return F.struct(line.alias("company_line"), F.coalesce(asks, F.array()).alias("employer"), F.coalesce(notes, F.array()).alias("notes"))


def checked_text(stage2: DataFrame, postings: DataFrame) -> DataFrame:
    """Stage-2 answers with the text their quotes are held against: title, company, location, description by line."""
    body = postings.select(F.col("job_url").alias("_u"), F.when(T.strip(T.text("description")) != "", F.concat_ws("\n", "title", "company", "location", "description")).alias("body"))
    return stage2.join(body, F.col("job_url") == F.col("_u"), "left").drop("_u")


def judged_answers(answers: DataFrame, prompts: DataFrame, rubric: DataFrame) -> DataFrame:
    """Landed Stage-2 answers (run_id, stage, n, raw, landed_at) to prompts (run_id, stage, n, job_url and the posting's
    columns) as results for the ledger.

    Unreadable ones have none; of several answers for a job the last to land counts (of those of one moment the
    greatest). Texts are brought to the answers that count, once.
    """
    key = ["run_id", "stage", "n"]
    given = answers.join(prompts.select(*key, "job_url"), key).where(parsed(F.col("raw"), STAGE2).isNotNull())
    last = cut(given.groupBy("job_url").agg(F.max(F.struct("landed_at", "raw", *key)).alias("x")).select("x.*"))
    wide = last.join(prompts, key)
    body = F.when(T.strip(T.text("description")) != "", F.concat_ws("\n", "title", "company", "location", "description"))
    criteria = cut(merged_criteria(wide.select("job_url", body.alias("body"), parsed(F.col("raw"), STAGE2)["criteria"].alias("results")), rubric))  # quotes are looked up once
    done = stage2_results(criteria).withColumnRenamed("job_url", "_u")
    return last.join(prompts.select(*key, "job_url", "title", "company"), key).join(done, F.col("job_url") == F.col("_u")).select(
        "job_url", F.array("job_url").alias("duplicate_job_urls"), "title", "company", "status", F.lit(2).alias("stage_reached"), "reasoning", "run_id", F.lit(None).cast("string").alias("source"),
        F.col("landed_at").alias("last_seen_at"), F.unix_micros("landed_at").alias("ord"),
    )


def pending(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts without a usable answer: (run_id, stage, n) with none parsed."""
    return prompts.join(answers.where("parsed is not null").select("run_id", "stage", "n"), ["run_id", "stage", "n"], "left_anti")


def feeding(stage0: DataFrame, outcomes: DataFrame, runs: DataFrame, stage: str) -> DataFrame:
    """The jobs that go into a stage: what passed the last earlier stage of the run, else all Stage-0 survivors.

    runs: run_id, stages; outcomes: run_id, stage, job_url, outcome. `settled` is false where that stage has no outcome yet.
    """
    earlier = F.filter("stages", lambda s: F.array_position(F.col("stages"), s) < F.array_position(F.col("stages"), F.lit(stage)))
    of = runs.where(F.array_contains("stages", stage)).select("run_id", F.try_element_at(earlier, F.lit(-1)).alias("_last"))
    df = stage0.join(of, "run_id")
    done = outcomes.select(F.col("run_id").alias("_r"), F.col("stage").alias("_s"), F.col("job_url").alias("_u"), "outcome")
    df = df.join(done, (F.col("run_id") == F.col("_r")) & (F.col("_last") == F.col("_s")) & (F.col("job_url") == F.col("_u")), "left")
    return df.where(F.col("_last").isNull() | F.col("outcome").isNull() | (F.col("outcome") == "pass")).select(*stage0.columns, (F.col("_last").isNull() | F.col("outcome").isNotNull()).alias("settled"))


def manifest(feed: DataFrame) -> DataFrame:
    """Prompts numbered 0, 1, 2 ... within (run_id, stage): what a model reads first (no_keyword last), by ord; counted by ranges, as a run may be most of the rows."""
    return numbered(feed, "n", F.col("no_keyword"), F.col("ord"), within=("run_id", "stage")).withColumn("n", F.col("n") - 1)


def remote_problems(answers: DataFrame, options: DataFrame) -> DataFrame:
    """job_url, problem of remote answers (job_url, answer): no verdict, no list, or an answer that is not listed.

    options: category, option; a small table.
    """
    verdict = answers.where(~F.lower(T.text("answer.verdict")).isin("pass", "fail")).select("job_url", F.lit("no pass/fail verdict").alias("problem"))
    none = answers.where("answer.answers is null").select("job_url", F.lit("no `answers` list").alias("problem"))
    given = answers.select("job_url", F.inline("answer.answers")).withColumn("answer", T.strip(F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit(UNKNOWN)))).where(F.col("answer") != UNKNOWN)
    known = options.select("category").distinct()
    given = given.join(known, F.col("id") == F.col("category"), "left_semi")
    odd = given.join(options, (F.col("id") == F.col("category")) & (F.col("answer") == F.col("option")), "left_anti")
    return verdict.unionByName(none).unionByName(odd.select("job_url", F.concat("id", F.lit(": '"), "answer", F.lit("' is not one of the listed answers")).alias("problem")))


def remote_judgment(answers: DataFrame, options: DataFrame) -> DataFrame:
    """job_url, verdict, reason, decided_by, evidence_sids, answers (one for each category, in order).

    answers: job_url, answer (REMOTE or null), shown (ids of the sentences in the prompt). options: cat_n, category,
    label, option, option_label, rule. An answer counts only with a sentence that was shown.
    """
    cats = options.groupBy("cat_n", "category", "label").agg(F.map_from_entries(F.collect_list(F.struct("option", F.struct("option_label", "rule")))).alias("known"))
    df = answers.join(F.broadcast(cats) if cats.count() <= 1000 else cats, F.lit(True))
    given = F.get(F.filter(F.coalesce(F.col("answer.answers"), F.array()), lambda a: a["id"] == F.col("category")), F.lit(0))
    df = df.withColumn("_g", given)
    value = T.strip(F.coalesce(F.nullif(F.col("_g.answer"), F.lit("")), F.lit(UNKNOWN)))
    sids = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.array_contains(F.col("shown"), s))
    df = df.withColumn("_v", value).withColumn("_e", sids(F.col("_g.evidence_sids"))).withColumn("_o", F.try_element_at("known", value))
    valid = F.col("_o").isNotNull() & (F.size("_e") > 0)
    note = F.when(F.col("_o").isNotNull() & (F.size("_e") == 0), F.concat(F.lit("The model answered '"), "_o.option_label", F.lit("' without pointing at a sentence; read as not stated."))).when((F.col("_v") != UNKNOWN) & F.col("_o").isNull(), F.concat(F.lit("The model gave an answer that is not listed ('"), "_v", F.lit("'); read as not stated."))).otherwise("")
    one = F.struct("cat_n", F.col("category").alias("id"), "label", F.when(valid, F.col("_v")).otherwise(UNKNOWN).alias("answer"), F.when(valid, F.col("_o.option_label")).otherwise("Not stated").alias("answer_label"), F.when(valid, T.strip(T.text("_g.detail"))).otherwise("").alias("detail"), F.when(valid, F.col("_o.rule")).otherwise("").alias("rule"), F.when(valid, F.col("_e")).otherwise(F.array().cast("array<string>")).alias("evidence_sids"), note.alias("note"))
    per = df.groupBy("job_url").agg(F.first("answer").alias("answer"), F.first("shown").alias("shown"), F.array_sort(F.collect_list(one)).alias("answers"))
    out = F.filter("answers", lambda a: a["rule"] == "fail")
    said = F.array_join(F.transform(out, lambda a: F.concat(a["label"], F.lit(": "), a["answer_label"], F.when(a["detail"] != "", F.concat(F.lit(" ("), a["detail"], F.lit(")"))).otherwise(""))), "; ")
    shown = sids(F.col("answer.evidence_sids"))
    passed = F.lower(T.text("answer.verdict")) == "pass"
    by = F.when(F.col("answer").isNull(), "code").when(F.size(out) > 0, "rule").otherwise("model")
    per = per.withColumn("decided_by", by).withColumn("_s", shown)
    good = (F.col("decided_by") == "model") & passed & (F.size("_s") > 0)
    reason = F.when(F.col("decided_by") == "code", NO_KEYWORD).when(F.col("decided_by") == "rule", said).when(passed & (F.size("_s") == 0), NO_EVIDENCE).otherwise(T.strip(T.text("answer.reason")))
    return per.select("job_url", F.when(good, "pass").otherwise("fail").alias("verdict"), reason.alias("reason"), "decided_by", F.when(good, F.col("_s")).otherwise(F.array().cast("array<string>")).alias("evidence_sids"), "answers")


def stage1_problems(shown: Column, answer: Column) -> Column:
    """Problems of a Stage-1 answer: ids not in the prompt, and a pass without evidence that was shown."""
    cited = F.coalesce(answer["evidence_sids"], F.array().cast("array<string>"))
    odd = F.array_except(cited, shown)
    passes = F.lower(T.text(answer["verdict"])) == "pass"
    return F.array_compact(F.array(F.when(F.size(odd) > 0, F.concat(F.lit("cites sentences that were not shown: "), F.array_join(odd, ", "))), F.when(passes & (F.size(F.array_intersect(cited, shown)) == 0), "pass without a sentence that was shown")))


def unread_sentences(matched: Column, answer: Column) -> Column:
    """Keyword sentences that the answer has no reading for (a warning)."""
    return F.array_except(matched, F.coalesce(F.map_keys(answer["readings"]), F.array().cast("array<string>")))


def stage1_outcomes(df: DataFrame) -> DataFrame:
    """outcome (pass, fail, pending), evidence sentences and blocks with readings of rows (job_url, blocks, answer, no_keyword)."""
    ids = F.coalesce(F.col("answer.evidence_sids"), F.array().cast("array<string>"))
    evidence = F.transform(F.filter("blocks", lambda b: F.array_contains(ids, b["s_id"])), lambda b: b["sentence"])
    outcome = F.when(F.col("no_keyword"), "fail").when(F.col("answer").isNull() | ~F.lower(T.text("answer.verdict")).isin("pass", "fail"), "pending").when((F.lower("answer.verdict") == "pass") & (F.size(evidence) > 0), "pass").when(F.lower("answer.verdict") == "pass", "pending").otherwise("fail")
    read = F.transform("blocks", lambda b: F.struct(b["s_id"].alias("s_id"), b["sentence"].alias("sentence"), F.when(b["matched"], F.try_element_at(F.col("answer.readings"), b["s_id"])).alias("reading")))
    return df.select("job_url", outcome.alias("outcome"), evidence.alias("evidence"), read.alias("t1_blocks"))


def remote_outcomes(answers: DataFrame, options: DataFrame) -> DataFrame:
    """job_url, outcome (passed, failed, pending) and the judgment; rows marked `auto` count as no answer read."""
    bad = remote_problems(answers.where("answer is not null and not auto"), options).select("job_url").distinct().withColumn("_bad", F.lit(True))
    judged = remote_judgment(answers.withColumn("answer", F.when(~F.col("auto"), F.col("answer"))), options)
    df = answers.select("job_url", "auto", F.col("answer").isNull().alias("_none")).join(bad, "job_url", "left").join(judged, "job_url")
    waits = ~F.col("auto") & (F.col("_none") | F.col("_bad").isNotNull())
    return df.select("job_url", F.when(waits, "pending").when(F.col("verdict") == "pass", "passed").otherwise("failed").alias("outcome"), "verdict", "reason", "decided_by")


def matched_keywords(blocks: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(blocks, lambda b: b["matched"]), lambda b: b["matched_keywords"])))


def matched_sentences(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["matched"]), lambda b: b["sentence"])


def shown_location(location: Column, others: Column) -> Column:
    return F.concat_ws(" / ", F.nullif(location, F.lit("")), F.array_join(others, " / "))


def rubric_excerpt(rubric: Column) -> Column:
    """The Pass and Fail sections of a rubric, or all of it if it has none."""
    kept = F.filter(F.split(rubric, "(?m)^(?=## )"), lambda s: s.rlike("^## (Pass|Fail)\\b"))
    return F.when(F.size(kept) > 0, T.strip(F.array_join(kept, ""))).otherwise(rubric)


def sentence_lines(blocks: Column, marks: tuple[str, str]) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat(b["s_id"], F.lit("["), F.when(b["s_id"] == "T", "title").when(b["matched"], marks[0]).otherwise(marks[1]), F.lit("] "), b["sentence"])), "\n")


def rendered(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), T.text(value))
    return out


def criteria_list(rubric: list[dict]) -> str:
    """The rubric's lines in a Stage-2 prompt: a text only where it says more than the label."""
    lines = []
    for c in rubric:
        body, label = " ".join((c.get("text") or "").split()), c["label"]
        says = body and body.rstrip(".").lower() != label.strip().rstrip(".").lower()
        lines.append(f"- {c['id']} ({c['kind']}) {label}" + f": {body}" * bool(says))
    return "\n".join(lines)


def remote_parts(config: dict) -> dict[str, str]:
    """What a Remote prompt says of its setup (guidance and categories of id, label, question and options), written once for all jobs."""
    conditions, questions = [], []
    for c in config["categories"]:
        conditions += [f"- {c['label']}: {o['label']} — " + ("rules a posting out" if o["rule"] == "fail" else "is fine") for o in c["options"]]
        listed = [f"    - `{key}`: {said}" for key, said in [*((o["id"], o["label"]) for o in c["options"]), (UNKNOWN, "the sentences do not say")]]
        questions.append("\n".join([f"- `{c['id']}` — {c['question']}", *listed]))
    return {"guidance": config.get("guidance") or "", "conditions": "\n".join(conditions), "questions": "\n".join(questions)}


def remote_prompts(jobs: DataFrame, template: str, config: dict) -> DataFrame:
    """prompt of each job (title, company, location, remote_blocks): the setup, the questions and the sentences with a keyword or beside one."""
    values = {k: F.lit(v) for k, v in remote_parts(config).items()} | {c: F.col(c) for c in ("title", "company", "location")}
    return jobs.withColumn("prompt", rendered(template, values | {"blocks": sentence_lines(F.col("remote_blocks"), ("K", "ctx"))}))


def stage2_prompts(jobs: DataFrame, template: str, rubric: list[dict]) -> DataFrame:
    """prompt of each job, null where the description is blank (those are skipped and counted)."""
    prompt = rendered(template, {"criteria_list": F.lit(criteria_list(rubric)), "title": F.col("title"), "company": F.col("company"), "location": F.col("location"), "description": F.col("description")})
    return jobs.withColumn("prompt", F.when(T.strip(T.text("description")) != "", prompt))


def assembled(remote_fails: DataFrame, stage1_fails: DataFrame, waiting: DataFrame, judged: DataFrame, no_text: DataFrame) -> DataFrame:
    """A run's rows (job_url, run_id, status, stage_reached, reasoning): five disjoint outcomes."""
    def rows(df: DataFrame, status: Column, stage: int) -> DataFrame:
        return df.select("job_url", "run_id", status.alias("status"), F.lit(stage).alias("stage_reached"), F.col("reasoning"))

    parts = [rows(remote_fails, F.lit("remote_fail"), 0), rows(stage1_fails, F.lit("stage1_fail"), 1), rows(waiting, F.col("status"), 1), rows(judged, F.col("status"), 2), rows(no_text.withColumn("reasoning", F.lit("The posting has no description.")), F.lit("stage2_fail"), 2)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
