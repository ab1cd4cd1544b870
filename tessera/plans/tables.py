"""The library's tables derived from the given ones, in Spark and, for the same rows, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL = "https://jobs.example.com/view/"
NOW = "1999-06-01 00:00:00"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: A posting and the next one share a URL; the ledger, which knows all numbers, knows every third pair.
POSTINGS = {
    "ord": "doc_id", "search_n": "cast(doc_id % 3 + 1 as int)", "page": "cast(doc_id % 1000 / 30 as int)", "run_id": "concat('run-', cast(doc_id % 5 as string))",
    "job_url": f"concat('{URL}', cast(doc_id - doc_id % 2 as string), case when doc_id % 6 < 2 then '' else '/new' end)", "term": "concat('term ', cast(doc_id % 3 as string))", "company": "concat(source, ' GmbH')", "location": "lang", "description": "text",
}
POSTINGS_SQL = f"""SELECT doc_id AS ord, CAST(doc_id % 3 + 1 AS INT) AS search_n, CAST(floor(doc_id % 1000 / 30.0) AS INT) AS page, 'run-' || (doc_id % 5) AS run_id,
 '{URL}' || (doc_id - doc_id % 2) || CASE WHEN doc_id % 6 < 2 THEN '' ELSE '/new' END AS job_url, 'term ' || (doc_id % 3) AS term, source || ' GmbH' AS company, lang AS location, text AS description,
 regexp_extract(text, '^[^\\n.]{{0,60}}', 0) AS title FROM documents"""


def postings(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select(*[F.expr(e).alias(n) for n, e in POSTINGS.items()], F.regexp_extract("text", "^[^\n.]{0,60}", 0).alias("title"))


LEDGER_SQL = f"""SELECT o_orderkey AS ord, '{URL}' || o_orderkey AS job_url, substr(sha256(lower('{URL}' || o_orderkey)), 1, 16) AS job_url_hash, 'title ' || (o_custkey % 50) AS title, 'company ' || (o_custkey % 7) AS company,
 CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'review' ELSE 'stage2_fail' END AS status, 2 AS stage_reached, o_orderpriority AS reasoning, 'run-' || year(o_orderdate) AS run_id, o_orderdate AS last_seen_at,
 CASE WHEN o_custkey % 2 = 0 THEN 'ats:lever/c' || (o_custkey % 40) END AS source, CASE o_custkey % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'skipped_fit' WHEN 2 THEN 'skipped_other' END AS user_action,
 CASE WHEN o_custkey % 3 = 1 THEN o_orderpriority END AS reason, CAST(NULL AS TIMESTAMP) AS decided_at, CASE WHEN o_custkey % 12 = 1 THEN 'applied' END AS review_status, CAST(NULL AS TIMESTAMP) AS pruned_at,
 o_orderpriority AS evidence, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS criteria FROM orders"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    url = f"concat('{URL}', cast(o_orderkey as string))"
    columns = {
        "ord": "o_orderkey", "job_url": url, "job_url_hash": f"substring(sha2(lower({url}), 256), 1, 16)", "title": "concat('title ', cast(o_custkey % 50 as string))", "company": "concat('company ', cast(o_custkey % 7 as string))",
        "status": "case o_orderstatus when 'F' then 'passed' when 'O' then 'review' else 'stage2_fail' end", "stage_reached": "2", "reasoning": "o_orderpriority", "run_id": "concat('run-', cast(year(o_orderdate) as string))", "last_seen_at": "cast(o_orderdate as timestamp)",
        "source": "case when o_custkey % 2 = 0 then concat('ats:lever/c', cast(o_custkey % 40 as string)) end", "user_action": "case o_custkey % 6 when 0 then 'applied' when 1 then 'skipped_fit' when 2 then 'skipped_other' end",
        "reason": "case when o_custkey % 3 = 1 then o_orderpriority end", "decided_at": "cast(null as timestamp)", "review_status": "case when o_custkey % 12 = 1 then 'applied' end", "pruned_at": "cast(null as timestamp)",
        "evidence": "o_orderpriority", "criteria": "case when o_orderkey % 3 = 0 then o_orderstatus end",
    }
    return read(spark, d, "orders").select(*[F.expr(e).alias(n) for n, e in columns.items()])


CRITERIA_SQL = f"""SELECT '{URL}' || l_orderkey AS job_url, l_linenumber AS ord, 'c' || l_linenumber AS id, 'criterion ' || l_linenumber AS label,
 CASE l_linenumber % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'preference' END AS kind, CASE WHEN l_linenumber IN (1, 4) THEN 'g1' END AS grp,
 CASE WHEN l_linenumber % 3 = 0 THEN CASE l_returnflag WHEN 'A' THEN 'not_applicable' WHEN 'N' THEN 'unclear' ELSE 'triggered' END ELSE CASE l_returnflag WHEN 'A' THEN 'met' WHEN 'N' THEN 'unclear' ELSE 'not_met' END END AS result,
 CASE WHEN l_quantity > 10 THEN 'line ' || CAST(l_quantity AS INT) END AS quote, l_linestatus = 'O' AS quote_verified, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE '' END AS why
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1"""


def criteria(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    columns = {
        "job_url": f"concat('{URL}', cast(l_orderkey as string))", "ord": "l_linenumber", "id": "concat('c', cast(l_linenumber as string))", "label": "concat('criterion ', cast(l_linenumber as string))",
        "kind": "case l_linenumber % 3 when 0 then 'fail' when 1 then 'pass' else 'preference' end", "grp": "case when l_linenumber in (1, 4) then 'g1' end",
        "result": "case when l_linenumber % 3 = 0 then case l_returnflag when 'A' then 'not_applicable' when 'N' then 'unclear' else 'triggered' end else case l_returnflag when 'A' then 'met' when 'N' then 'unclear' else 'not_met' end end",
        "quote": "case when l_quantity > 10 then concat('line ', cast(cast(l_quantity as int) as string)) end", "quote_verified": "l_linestatus = 'O'", "why": "case when l_quantity > 25 then l_returnflag else '' end",
    }
    return read(spark, d, "lineitem").withColumn("_k", first).where("_k = 1").select(*[F.expr(e).alias(n) for n, e in columns.items()])


#: Board postings from parts: every supplier nation is a board, a part's name a title.
BOARD_SQL = "SELECT 'lever' AS vendor, 'b' || (p_partkey % 25) AS slug, p_partkey AS ord, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (m/w/d)' ELSE '' END AS title, p_type AS description, p_brand AS url, CAST(p_size AS VARCHAR) AS ref FROM part"


def board_postings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr("'lever' as vendor", "concat('b', cast(p_partkey % 25 as string)) as slug", "p_partkey as ord", "concat(p_name, case when p_partkey % 3 = 0 then ' (m/w/d)' else '' end) as title", "p_type as description", "p_brand as url", "cast(p_size as string) as ref")


#: Outcomes of stages from events.
OUTCOMES_SQL = f"SELECT 'run-' || (user_id % 20) AS run_id, CASE event_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'stage1' ELSE 'stage2' END AS stage, '{URL}' || event_id AS job_url, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'pending' ELSE 'pass' END AS outcome, ts, user_id, event_id, event_type, value, props FROM events"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").selectExpr(
        "concat('run-', cast(user_id % 20 as string)) as run_id", "case event_id % 3 when 0 then 'remote' when 1 then 'stage1' else 'stage2' end as stage", f"concat('{URL}', cast(event_id as string)) as job_url",
        "case event_type when 'error' then 'fail' when 'view' then 'pending' else 'pass' end as outcome", "cast(ts as timestamp) as ts", "user_id", "event_id", "event_type", "value", "props",
    )
