"""Stage 0: plan searches, merge what they found, drop mismatches by rules in order, and count every drop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import profiles
from tessera.functions import text as T
from tessera.functions import vectorized as V
from tessera.operators import linkage
from tessera.operators.graph import cut, numbered

RULES = ("language", "no_tier1_hit", "exclude_keyword", "language_requirement", "no_remote_keyword", "duplicate_content", "already_seen")
STAGES = ("remote", "stage1", "stage2")


def search_plan(terms: DataFrame, places: DataFrame) -> DataFrame:
    """search_n, term, place: terms by places in their order (columns term_n, term; place_n, place); a term is searched once without a place."""
    if "profile_id" in terms.columns:
        both = terms.join(places, "profile_id", "left")
        return both.withColumn("search_n", F.row_number().over(Window.partitionBy("profile_id").orderBy("term_n", F.col("place_n").asc_nulls_first())))
    both = terms.join(places, F.lit(True), "left")  # terms by places is what is asked for; Spark takes the smaller side
    return numbered(both, "search_n", F.col("term_n"), F.col("place_n").asc_nulls_first()).withColumn("search_n", F.col("search_n").cast("int"))


def merged_searches(postings: DataFrame) -> DataFrame:
    """One row for each job_url, the first to arrive (by ord), with the distinct terms that returned it in their order.

    Keys and terms are aggregated without the wide columns; the winning rows are joined back by ord, so that each
    description is shuffled once.
    """
    each = postings.where("job_url is not null").groupBy("job_url", "term").agg(F.min("ord").alias("ord"))
    keys = each.groupBy("job_url").agg(F.min("ord").alias("_first"), F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("_t"))
    terms = keys.select("_first", F.transform("_t", lambda x: x["term"]).alias("search_terms"))
    return postings.join(terms, F.col("ord") == F.col("_first")).drop("_first", "term")


def pages_read(results: DataFrame, matches: Column, streak: int = 15, most: int = 1000) -> DataFrame:
    """Rows of raw results (search_n, page, pos, job_url, title) on pages up to where a search stops: the first gap in
    pages, `streak` pages in a row without a match, or `most` results; a URL counts on its first page only."""
    seen = Window.partitionBy("search_n", "job_url").orderBy("page", "pos")
    new = results.withColumn("_k", F.row_number().over(seen)).where("_k = 1").drop("_k")
    pages = new.groupBy("search_n", "page").agg(F.count("*").alias("n"), F.max(matches).alias("hit"))
    order = Window.partitionBy("search_n").orderBy("page")
    pages = pages.withColumn("_gap", F.col("page") - F.row_number().over(order) - F.min("page").over(Window.partitionBy("search_n")) + 1)
    pages = pages.withColumn("_hit", F.last(F.when(F.col("hit"), F.col("page")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    pages = pages.withColumn("_total", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.min("page").over(Window.partitionBy("search_n"))
    open_ = (F.col("_gap") == 0) & (F.col("page") - F.coalesce(F.col("_hit"), first - 1) <= streak) & (F.col("_total") < most)
    pages = pages.withColumn("_read", F.min(open_).over(order)).where("_read").select(F.col("search_n").alias("_s"), F.col("page").alias("_p"))
    return new.join(pages, (F.col("search_n") == F.col("_s")) & (F.col("page") == F.col("_p"))).drop("_s", "_p")


def active_keywords(keywords: DataFrame, reads: list[str]) -> DataFrame:
    """Keywords (keyword, language) without those marked with a language not read any more; nothing read keeps all."""
    return keywords if not reads else keywords.where(F.col("language").isNull() | F.col("language").isin(reads))


def uncovered_languages(reads: DataFrame, keywords: DataFrame, first: str) -> DataFrame:
    """Languages read (code) that no keyword is in; unmarked keywords count for the first; without keywords there is no gap."""
    covered = keywords.select(F.coalesce("language", F.lit(first)).alias("code")).distinct()
    some = keywords.select(F.lit(True).alias("_any")).limit(1)
    return reads.select("code").distinct().join(F.broadcast(some)).drop("_any").join(covered, "code", "left_anti")


def stage_plan(chosen: Column) -> Column:
    return F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: F.array_contains(chosen, s))


def rubric_problems(criteria: DataFrame) -> DataFrame:
    """rubric, problem of rubric rows (rubric, id, label, kind, ord)."""
    twice = criteria.groupBy("rubric", "id").count().where("id <> '' and count > 1").select("rubric", F.concat(F.lit("duplicate id "), "id").alias("problem"))
    bare = criteria.where("coalesce(id, '') = '' or trim(coalesce(label, '')) = ''").select("rubric", F.lit("criterion needs id and label").alias("problem"))
    kind = criteria.where("coalesce(id, '') <> '' and coalesce(kind, '') not in ('pass', 'fail', 'preference')").select("rubric", F.concat("id", F.lit(": unknown kind")).alias("problem"))
    none = criteria.groupBy("rubric").agg(F.max(F.coalesce(F.col("kind") == "pass", F.lit(False))).alias("p")).where("not p").select("rubric", F.lit("no pass criteria").alias("problem"))
    return twice.unionByName(bare).unionByName(kind).unionByName(none)


def waterfall(postings: DataFrame, languages: list[str], tier1: list[str], exclude: list[str], remote: list[str] | None = None, stage1: bool = True, drop_without_keywords: bool = True, terms: list[str] | None = None, language_column: str | None = None, detect: Callable[[Column], Column] | None = None) -> DataFrame:
    """The postings with blocks, content hash, requirement and drop_reason: the first rule, in order, that drops them.

    Postings that the language rule drops have no blocks (null): their texts are not read further. For the others
    sentences are cut in the JVM and one Arrow pass looks up all keywords. Languages come from an existing column, from a
    detector (language.detector() of profiles made from labelled texts), or else from counted stop words.
    """
    detected = F.col(language_column) if language_column else (detect or V.detect_language())(F.coalesce("description", F.lit("")))
    short = F.length(T.strip(T.text("description"))) < 20
    foreign = F.lit(bool(languages)) & ~short & F.coalesce(~detected.isin(languages or [""]), F.lit(False))
    df = postings.withColumn("_foreign", foreign)
    df = df.withColumn("_b", V.keyword_blocks(tier1, remote or [], terms or [])(F.col("title"), F.when(~F.col("_foreign"), T.sentences("description"))))
    df = df.withColumn("requirement", F.when(F.col("_foreign"), "").otherwise(T.requirement("title", "description", languages)))
    df = df.select("*", "_b.t1_blocks", "_b.remote_blocks", "_b.title_hits").drop("_b")
    reason = F.when(F.col("_foreign"), "language")
    if stage1:
        reason = reason.when(F.size("t1_blocks") == 0, "no_tier1_hit")
    reason = reason.when(T.excluded("title", "description", exclude), "exclude_keyword").when(F.col("requirement") != "", "language_requirement")
    if remote is not None and drop_without_keywords:
        reason = reason.when(F.size("remote_blocks") == 0, "no_remote_keyword")
    own = T.block_signature(F.col("t1_blocks"))
    sign = own if remote is None else F.when(F.size("t1_blocks") == 0, T.block_signature(F.col("remote_blocks"))).otherwise(own)
    return df.withColumn("content_hash", sign).withColumn("drop_reason", reason).drop("_foreign")


def profile_screen(postings: DataFrame, keywords: DataFrame, window: int = 1) -> DataFrame:
    """profile_id, ord, keywords (in the profile's order), matched and blocks (numbers of sentences) of every profile that has a keyword in a posting.

    keywords: profile_id, place, keyword. All profiles are looked up in one pass over each text; of the postings only
    hits go on, by (profile, posting), so neither a profile nor a posting is a hot key. A profile without a keyword in
    a posting has no row: that is its no_tier1_hit.
    """
    owners, texts = profiles.numbered_keywords(keywords)
    lines = F.array_join(T.sentences("description"), "\n")
    found = postings.select("ord", profiles.keyword_hits(texts)(lines).alias("x")).select("ord", F.col("x.lines").alias("_n"), F.explode("x.hits").alias("h")).select("ord", "_n", "h.keyword_n", F.col("h.lines").alias("at"))
    each = found.join(owners, "keyword_n").groupBy("profile_id", "ord").agg(F.max("_n").alias("_n"), F.array_sort(F.collect_set(F.struct("place", "keyword"))).alias("_k"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("_at"))
    near = F.flatten(F.transform("_at", lambda i: F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, F.col("_n") - 1))))
    return each.select("profile_id", "ord", F.array_distinct(F.transform("_k", lambda x: x["keyword"])).alias("keywords"), F.size("_at").alias("matched"), F.size(F.array_distinct(near)).alias("blocks"))


def screened(filtered: DataFrame, ledger: DataFrame) -> DataFrame:
    """The waterfall's rows with its last two reasons: survivors that repost an earlier survivor, then those in the ledger.

    Reposts are found first, so a seen representative hides its unseen duplicates. The rows are written once, for the
    text work is not to run again; of the ledger only the hash is read.
    """
    filtered = cut(filtered)
    left = filtered.where("drop_reason is null")
    groups = linkage.repost_groups(left).select(F.col("ord").alias("_o"), (F.col("ord") != F.col("root")).alias("_again"))
    known = ledger.select(F.col("job_url_hash").alias("_h")).where("_h is not null").distinct()
    seen = left.select(F.col("ord").alias("_s"), T.url_hash("job_url").alias("_u")).join(known, F.col("_u") == F.col("_h"), "left_semi").select("_s")
    late = groups.join(seen, F.col("_o") == F.col("_s"), "left")
    late = late.select("_o", F.when(F.col("_again"), "duplicate_content").when(F.col("_s").isNotNull(), "already_seen").alias("_late")).where("_late is not null")
    return filtered.join(late, F.col("ord") == F.col("_o"), "left").withColumn("drop_reason", F.coalesce("drop_reason", "_late")).drop("_o", "_late")


def of_title(filtered: DataFrame) -> DataFrame:
    """The rows whose title has a term that returned them (columns title_hits, search_terms); the first to be left out of a search."""
    return filtered.where(title_matches(F.col("title_hits"), F.col("search_terms")))


def title_matches(hits: Column, terms: Column) -> Column:
    """Whether a term that returned the posting is in its title."""
    return F.exists(terms, lambda t: F.array_contains(hits, t))


def requirement_evidence(filtered: DataFrame) -> DataFrame:
    return filtered.where("drop_reason = 'language_requirement'").select("job_url", "title", "company", "location", F.col("drop_reason").alias("reason"), F.col("requirement").alias("evidence"))


def drop_counts(filtered: DataFrame) -> DataFrame:
    """outcome, n: those that passed and the drops of each rule, 0 where it drops none."""
    counts = filtered.groupBy(F.coalesce("drop_reason", F.lit("passed")).alias("_o")).agg(F.count("*").alias("n"))
    every = filtered.sparkSession.createDataFrame([(r,) for r in ("passed", *RULES)], "outcome string")
    return every.join(counts, F.col("outcome") == F.col("_o"), "left").select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def titles_left_out(results: DataFrame, matches: Column) -> DataFrame:
    """search_n, title, n of titles without a match, most frequent first within a search (column place)."""
    per = results.where(~matches).groupBy("search_n", "title").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("search_n").orderBy(F.desc("n"), "title")))


def search_totals(results: DataFrame, *by: str) -> DataFrame:
    """Of each search (of each run or the like, if `by` names it): rows read, distinct URLs, and those from company boards (source like ats:...)."""
    return results.groupBy(*by, "search_n").agg(F.count("*").alias("read"), F.count_distinct("job_url").alias("kept"), F.count_if(F.col("source").startswith("ats:")).alias("from_ats"))


def run_totals(searches: DataFrame, progress: DataFrame) -> DataFrame:
    """run_id, total, done of runs: what their searches (run_id, search_n) kept so far, and whether all of them are done.

    progress: run_id, search_n, kept, done as last reported; a search without a report has kept none and is not done.
    """
    told = progress.select(F.col("run_id").alias("_r"), F.col("search_n").alias("_s"), "kept", "done")
    each = searches.join(told, (F.col("run_id") == F.col("_r")) & (F.col("search_n") == F.col("_s")), "left")
    return each.groupBy("run_id").agg(F.sum(F.coalesce("kept", F.lit(0))).alias("total"), F.bool_and(F.coalesce("done", F.lit(False))).alias("done"))


def keyword_coverage(blocks: DataFrame, keywords: DataFrame) -> DataFrame:
    """keyword, postings of every keyword, matched or not (0); `blocks` has a column matched_keywords of each posting."""
    hits = blocks.select(F.explode(F.array_distinct("matched_keywords")).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("postings"))
    return keywords.select("keyword").distinct().join(hits, "keyword", "left").na.fill(0, ["postings"])
