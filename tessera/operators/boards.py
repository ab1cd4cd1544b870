"""Company boards: lookups, enrichment, probing, and what is closed.

Boards are rows (company_key, vendor, slug, ...); board postings are rows (vendor, slug, ord, title, description, ref).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import numbered

#: Days until a miss is looked up again, and the vendors that are tried, in order.
RETRY_DAYS = 30
# The vendors whose boards are looked for, in this order.
PROBED = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "recruitee", "lever_eu", "teamtailor")
BATCH = 500


def board_of(companies: DataFrame, shared: DataFrame, local: DataFrame) -> DataFrame:
    """The companies with vendor and slug: the shipped list first, then the local one."""
    one = shared.select(F.col("company_key").alias("_k1"), F.struct("vendor", "slug").alias("_b1"))
    two = local.where("vendor is not null").select(F.col("company_key").alias("_k2"), F.struct("vendor", "slug").alias("_b2"))
    df = companies.withColumn("company_key", T.company_key("company"))
    df = df.join(one, F.col("company_key") == F.col("_k1"), "left").join(two, F.col("company_key") == F.col("_k2"), "left")
    return df.withColumn("_b", F.coalesce("_b1", "_b2")).select(*df.columns[: len(companies.columns) + 1], "_b.vendor", "_b.slug")


def by_title(board_postings: DataFrame) -> DataFrame:
    """vendor, slug, norm_title and the first posting; titles with several different texts (or refs) give no answer."""
    body = T.strip(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("ref"), F.lit("")))
    df = board_postings.withColumn("norm_title", T.norm("title")).withColumn("_body", body)
    per = df.groupBy("vendor", "slug", "norm_title").agg(F.count_distinct("_body").alias("_n"), F.min_by(F.struct("title", "description", "url", "ref"), "ord").alias("post"))
    return per.where("_n = 1").drop("_n")


def enriched(postings: DataFrame, board_postings: DataFrame) -> DataFrame:
    """Postings (with vendor, slug) with the board's text and URL where a title matches; an empty text changes nothing."""
    found = by_title(board_postings).select(F.col("vendor").alias("_v"), F.col("slug").alias("_s"), F.col("norm_title").alias("_t"), "post")
    df = postings.withColumn("_n", T.norm("title"))
    df = df.join(found, (F.col("vendor") == F.col("_v")) & (F.col("slug") == F.col("_s")) & (F.col("_n") == F.col("_t")), "left")
    hit = T.strip(T.text("post.description")) != ""
    return df.select(*[c for c in postings.columns if c not in ("description", "source", "job_url_direct")], F.when(hit, F.col("post.description")).otherwise(F.col("description")).alias("description"), F.when(hit, T.source_of(F.col("vendor"), F.col("slug"))).alias("source"), F.when(hit, F.col("post.url")).alias("job_url_direct"), F.coalesce(hit, F.lit(False)).alias("from_board"))


def confirmed(enriched_: DataFrame) -> DataFrame:
    return enriched_.where("from_board").select("vendor", "slug").distinct()


def to_look_up(companies: DataFrame, shared: DataFrame, local: DataFrame, now) -> DataFrame:
    """company_key and first name of companies in neither list, or missed longer than RETRY_DAYS ago."""
    df = companies.withColumn("company_key", T.company_key("company")).where("company_key <> ''")
    first = df.groupBy("company_key").agg(F.min_by("company", "ord").alias("company"))
    first = first.join(shared.select("company_key"), "company_key", "left_anti")
    known = local.select(F.col("company_key").alias("_k"), F.col("vendor").alias("_v"), "checked_at")
    df = first.join(known, F.col("company_key") == F.col("_k"), "left")
    return df.where(F.col("_k").isNull() | (F.col("_v").isNull() & T.older_than(F.col("checked_at"), now, RETRY_DAYS))).select("company_key", "company")


def probed(companies: DataFrame, filled: DataFrame) -> DataFrame:
    """Of each company the first slug, then the first vendor, whose board (a row of `filled`) lists a posting; misses stay, null."""
    tries = companies.select("company_key", F.posexplode(T.slugs("company")).alias("slug_n", "guess"))
    order = F.array(*[F.struct(F.lit(i).alias("vendor_n"), F.lit(v).alias("vendor")) for i, v in enumerate(PROBED)])
    tries = tries.select("*", F.inline(order))
    slug = F.when(F.col("vendor") == "teamtailor", F.concat("guess", F.lit(".teamtailor.com"))).otherwise(F.col("guess"))
    tries = tries.withColumn("slug", slug).where("vendor <> 'teamtailor' or length(guess) <= 63")
    hit = tries.join(filled.select("vendor", "slug").distinct(), ["vendor", "slug"], "left_semi").groupBy("company_key").agg(F.min_by(F.struct("vendor", "slug"), F.struct("slug_n", "vendor_n")).alias("b"))
    return companies.select("company_key").distinct().join(hit, "company_key", "left").select("company_key", "b.vendor", "b.slug")


def still_open(watched: DataFrame, board_postings: DataFrame) -> DataFrame:
    """The watched jobs with `open`: true, false, or null where the board gave no answer."""
    lists = board_postings.select("vendor", "slug").distinct().withColumn("_answered", F.lit(True))
    titles = board_postings.select("vendor", "slug", T.norm("title").alias("_n")).distinct().withColumn("_there", F.lit(True))
    df = watched.withColumn("_b", T.board_of_source("source")).select("*", "_b.vendor", "_b.slug").drop("_b").withColumn("_n", T.norm("title"))
    df = df.join(lists, ["vendor", "slug"], "left").join(titles, ["vendor", "slug", "_n"], "left")
    return df.withColumn("open", F.when(F.col("_answered"), F.coalesce("_there", F.lit(False)))).select(*watched.columns, "open")


def closing(watched: DataFrame, ledger: DataFrame, now) -> DataFrame:
    """What to do with each watched job (with `open`): close, drop from the watch, forget or keep."""
    status = ledger.select(F.col("job_url").alias("_u"), "status", "user_action")
    df = watched.join(status, F.col("job_url") == F.col("_u"), "left")
    shown = F.coalesce(F.col("status").isin("passed", "review"), F.lit(False))
    action = F.when(shown & F.col("user_action").isNotNull(), "drop").when(shown & (F.col("open") == F.lit(False)), "close")
    return df.withColumn("action", action.when(~shown & T.older_than(F.col("read_at"), now, RETRY_DAYS), "forget").otherwise("keep")).drop("_u")


def to_share(local: DataFrame, shared: DataFrame, sent: DataFrame) -> DataFrame:
    """Confirmed valid local boards not shipped nor sent, in batches (batch_n from 0) of BATCH.

    Places in a batch come from counts of ranges of keys, not from one sorted task.
    """
    ok = local.where("confirmed").where(T.valid_board(F.col("vendor"), F.col("slug")))
    df = ok.join(shared.select("company_key"), "company_key", "left_anti").join(sent.select("company_key"), "company_key", "left_anti")
    return numbered(df, "n", F.col("company_key")).withColumn("batch_n", F.floor((F.col("n") - 1) / BATCH)).drop("n")


def contributions(offered: DataFrame, filled: DataFrame) -> DataFrame:
    """Offered boards (company_key, name, vendor, slug) with the reason they are refused, null if they are good."""
    lists = filled.select("vendor", "slug").distinct().withColumn("_there", F.lit(True))
    df = offered.join(lists, ["vendor", "slug"], "left")
    reason = F.when(~F.col("company_key").eqNullSafe(T.company_key("name")), "key is not the company's").when(~T.valid_board(F.col("vendor"), F.col("slug")), "unknown vendor or name").when(F.col("_there").isNull(), "lists no postings")
    return df.select(*offered.columns, reason.alias("reason"))


def merged_boards(shared: DataFrame, good: DataFrame, source: str) -> DataFrame:
    """The shipped list and the good new ones; what is there stays."""
    new = good.join(shared.select("company_key"), "company_key", "left_anti").dropDuplicates(["company_key"])
    return shared.select("company_key", "name", "vendor", "slug", "source").unionByName(new.select("company_key", "name", "vendor", "slug", F.lit(source).alias("source")))


def candidates(companies: DataFrame) -> DataFrame:
    """Boards from source lists (source_n, name, urls): of each company the first URL that is a board, the first source wins."""
    urls = companies.select("source_n", "name", F.posexplode("urls").alias("url_n", "url")).withColumn("b", T.board_from_url("url")).where("b is not null")
    urls = urls.withColumn("company_key", T.company_key("name")).where("company_key <> ''")
    return urls.groupBy("company_key").agg(F.min_by(F.struct("name", "b"), F.struct("source_n", "url_n", "name")).alias("x")).select("company_key", "x.name", "x.b.vendor", "x.b.slug")
