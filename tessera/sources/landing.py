"""What lands: search results, board payloads and model answers, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectorized import first_json_object, html_unescape

POSTING = "job_url string, title string, company string, location string, description string, job_url_direct string"
NUMBER = r"/(\d+)\.json$"
# Each vendor's payload; what is not named here is not read.
PAYLOADS = {
    "greenhouse": "jobs array<struct<title:string,content:string,absolute_url:string,id:string>>",
    "lever": "array<struct<text:string,descriptionPlain:string,lists:array<struct<text:string,content:string>>,additionalPlain:string,hostedUrl:string,id:string>>",
    "ashby": "jobs array<struct<title:string,descriptionPlain:string,descriptionHtml:string,jobUrl:string,id:string>>",
    "workable": "jobs array<struct<title:string,description:string,url:string,shortcode:string>>",
    "recruitee": "offers array<struct<title:string,description:string,requirements:string,careers_url:string,id:string>>",
    "smartrecruiters": "content array<struct<name:string,id:string,ref:string>>",
    "bamboohr": "result array<struct<jobOpeningName:string,id:string>>",
}
COLUMNS = ("vendor", "slug", "ord", "title", "description", "url", "ref")


def landed_searches(spark: SparkSession, folder: str) -> DataFrame:
    """Search results, a JSON list in each file named by its search's number; progress and skip files have other names."""
    rows = spark.read.schema(POSTING).option("multiLine", True).option("pathGlobFilter", "[0-9]*.json").json(folder)
    rows = rows.withColumn("search_n", F.regexp_extract(F.col("_metadata.file_path"), NUMBER, 1)).where("search_n <> '' and job_url is not null")
    return rows.withColumn("search_n", F.col("search_n").cast("int"))


def land_searches(results: DataFrame, folder: str) -> None:
    """Results (search_n and the posting's columns) as landed_searches() reads them: <n>.json, one JSON list for each search.

    A search returns a bounded number of results, so its list is one row.
    """
    spark = results.sparkSession
    row = F.to_json(F.struct(*[c for c in results.columns if c != "search_n"]))
    lists = results.groupBy("search_n").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(row), ",\n"), F.lit("\n]")).alias("value"))
    lists.write.mode("overwrite").partitionBy("search_n").text(f"{folder}/_landing")
    named(spark, f"{folder}/_landing", "search_n", folder)


def named(spark: SparkSession, written: str, by: str, folder: str) -> None:
    """Files of a folder partitioned by a column, one for each value, moved to <folder>/<value>.json."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(path(f"{written}/{by}=*/part-*")):
        fs.rename(part.getPath(), path(f"{folder}/{part.getPath().getParent().getName().partition('=')[2]}.json"))
    fs.delete(path(written), True)


def clean_values(df: DataFrame) -> DataFrame:
    """NaN as null; what is neither text, number nor truth value as its string."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        elif kind not in ("string", "int", "bigint", "smallint", "tinyint", "boolean"):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def board_postings(payloads: DataFrame) -> DataFrame:
    """Board postings from payload rows (vendor, slug, body): one branch of expressions for each JSON vendor."""
    parts = [_json(payloads, "greenhouse", "x.jobs", {"title": "title", "html": "content", "url": "absolute_url"})]
    lever = _body(payloads, ("lever", "lever_eu"), PAYLOADS["lever"]).select("vendor", "slug", F.posexplode_outer("x").alias("ord", "p")).where("p is not null")
    lists = F.array_join(F.transform(F.coalesce("p.lists", F.array()), lambda x: F.concat_ws("\n", x["text"], T.plain(x["content"], lambda c: c))), "\n")
    parts.append(lever.select("vendor", "slug", "ord", F.col("p.text").alias("title"), F.array_join(F.filter(F.array("p.descriptionPlain", lists, "p.additionalPlain"), lambda t: T.text(t) != ""), "\n").alias("description"), F.col("p.hostedUrl").alias("url"), F.lit(None).cast("string").alias("ref")))
    parts.append(_json(payloads, "ashby", "x.jobs", {"title": "title", "text": "descriptionPlain", "html": "descriptionHtml", "url": "jobUrl"}))
    parts.append(_json(payloads, "workable", "x.jobs", {"title": "title", "html": "description", "url": "url"}))
    parts.append(_json(payloads, "recruitee", "x.offers", {"title": "title", "html": "description", "more": "requirements", "url": "careers_url"}))
    parts.append(_json(payloads, "smartrecruiters", "x.content", {"title": "name", "ref": "id"}))
    bamboo = _json(payloads, "bamboohr", "x.result", {"title": "jobOpeningName", "ref": "id"})
    parts.append(bamboo.where(F.col("ref").rlike(r"^[0-9]+\z")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _body(payloads: DataFrame, vendors: tuple[str, ...], schema: str) -> DataFrame:
    return payloads.where(F.col("vendor").isin(*vendors)).select("vendor", "slug", F.from_json("body", schema).alias("x"))


def _json(payloads: DataFrame, vendor: str, path: str, fields: dict[str, str]) -> DataFrame:
    rows = _body(payloads, (vendor,), PAYLOADS[vendor]).select("vendor", "slug", F.posexplode_outer(path).alias("ord", "p")).where("p is not null")
    none = F.lit(None).cast("string")
    at = lambda name: F.col(f"p.{fields[name]}") if name in fields else none
    html = T.plain(F.concat_ws("\n", at("html"), at("more")), html_unescape) if "html" in fields else none
    body = F.coalesce(F.nullif(at("text"), F.lit("")), html) if "text" in fields else html
    return rows.select("vendor", "slug", "ord", at("title").alias("title"), body.alias("description"), at("url").alias("url"), at("ref").alias("ref"))


def rss_postings(payloads: DataFrame) -> DataFrame:
    """teamtailor: one posting for each item of an RSS feed."""
    item = F.regexp_extract_all("body", F.lit("(?s)<item\\b.*?</item>"), F.lit(0))
    rows = payloads.where("vendor = 'teamtailor'").select("vendor", "slug", F.posexplode(item).alias("ord", "i"))
    x = F.from_xml("i", "title string, link string, description string", {"rowTag": "item"})
    rows = rows.withColumn("x", x)
    return rows.select("vendor", "slug", "ord", F.col("x.title").alias("title"), T.plain("x.description", html_unescape).alias("description"), F.col("x.link").alias("url"), F.lit(None).cast("string").alias("ref"))


def position_postings(payloads: DataFrame) -> DataFrame:
    """personio: positions of the default and the English feed (feed_n) by id: every title, with the last description that is not empty."""
    item = F.regexp_extract_all("body", F.lit("(?s)<position\\b.*?</position>"), F.lit(0))
    rows = payloads.where("vendor = 'personio'").select("vendor", "slug", "feed_n", F.posexplode(item).alias("pos", "i"))
    x = F.from_xml("i", "id string, name string, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>", {"rowTag": "position"})
    rows = rows.withColumn("x", x).withColumn("d", F.array_join(F.transform("x.jobDescriptions.jobDescription", lambda d: F.concat_ws("\n", d["name"], d["value"])), "\n"))
    rows = rows.withColumn("description", T.plain("d", html_unescape))
    some = T.text("description") != ""
    per = rows.groupBy("vendor", "slug", F.col("x.id").alias("ref")).agg(F.min("pos").alias("ord"), F.array_sort(F.collect_list(F.struct("feed_n", "pos", F.col("x.name").alias("t")))).alias("ts"), F.max_by(F.when(some, F.col("description")), F.when(some, F.struct("feed_n", "pos"))).alias("description"))
    return per.select("vendor", "slug", "ord", F.explode(F.array_distinct(F.transform("ts", lambda t: t["t"]))).alias("title"), "description", F.lit(None).cast("string").alias("url"), "ref")


def with_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Postings without a text, with that of their landed detail payload (vendor, slug, ref, body)."""
    smart = F.from_json("body", "jobAd struct<sections:map<string,struct<title:string,text:string>>>")
    bamboo = F.from_json("body", "result struct<jobOpening:struct<jobOpeningStatus:string,description:string>>")
    sections = F.array_join(F.transform(F.map_values(smart["jobAd"]["sections"]), lambda s: T.text(s["text"])), "\n")
    opening = bamboo["result"]["jobOpening"]
    raw = F.when(F.col("vendor") == "smartrecruiters", sections).when((F.col("vendor") == "bamboohr") & (opening["jobOpeningStatus"] == "Open"), opening["description"])
    found = details.select(F.col("vendor").alias("_v"), F.col("slug").alias("_s"), F.col("ref").alias("_r"), raw.alias("_raw"))
    df = postings.join(found, (F.col("vendor") == F.col("_v")) & (F.col("slug") == F.col("_s")) & (F.col("ref") == F.col("_r")), "left")
    df = df.withColumn("_d", T.plain("_raw", html_unescape))
    return df.withColumn("description", F.coalesce(F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("_d"), F.lit("")))).drop("_v", "_s", "_r", "_raw", "_d")


def small_table(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """A configuration file with its defaults filled in."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns])


def landed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """n, raw of answer files, read whole."""
    rows = spark.read.text(folder, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), NUMBER, 1).cast("int").alias("n"), F.col("value").alias("raw"))


def object_in(raw):
    """The first JSON object within free text (prose may surround it), as JSON."""
    return first_json_object(T.text(raw))
