"""Reposts: which postings are the same, their groups, and views that show each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import cut, roots
from tessera.sources import bucketed

#: Jaccard likeness of word sets, in hundredths.
ALIKE = 85
#: Nodes that are listed under one word before a second one is asked for.
LISTED = 200


def hash_edges(postings: DataFrame) -> DataFrame:
    """a, b (ord): every posting to the first with its content hash: a star, not all pairs."""
    some = cut(postings.where("content_hash <> ''").select("ord", "content_hash"))  # read twice, hashed once
    first = some.groupBy("content_hash").agg(F.min("ord").alias("a")).withColumnRenamed("content_hash", "_h")
    return some.join(first, F.col("content_hash") == F.col("_h")).where("a <> ord").select("a", F.col("ord").alias("b"))


def candidates(node: DataFrame, most: int = LISTED) -> DataFrame:
    """a, b: nodes (k, a, w: distinct words, n: how many) of one key that may be ALIKE, every pair that is among them.

    Words are ordered by how many nodes of the key have them. Of two sets of a <= b words that are alike, at least
    c = (a + b) * ALIKE / (100 + ALIKE) are shared, so their first shared word is among the first a - c + 1 and
    b - c + 1: the smaller set is listed under its first a - 2 a * ALIKE / (100 + ALIKE) + 1 words only, and a shared
    word counts if enough words are left behind it on either side. A list of more than `most` nodes is cut by a second
    word, as two of the first a - c + 2 are shared too; so is each piece of one key, however many nodes it has.
    """
    word = node.select("k", "a", "n", F.explode("w").alias("x"))
    shared = word.groupBy("k", "x").agg(F.count("*").alias("df")).where("df > 1")
    # Words of one node only come first in its order; they are counted, not listed.
    mine = word.join(shared, ["k", "x"]).withColumn("own", F.count("*").over(Window.partitionBy("k", "a")))
    mine = mine.withColumn("p", F.row_number().over(Window.partitionBy("k", "a").orderBy("df", "x")) + F.col("n") - F.col("own"))
    probe, index = F.col("n") - F.ceil(F.col("n") * ALIKE / 100) + 1, F.col("n") - F.ceil(F.col("n") * (2 * ALIKE / (100 + ALIKE)) - 1e-9) + 1
    first = cut(mine.where(F.col("p") <= probe + 1).select("k", "x", "a", "n", "p", index.alias("index"), probe.alias("probe")))
    hot = first.where("p <= probe").groupBy("k", "x").agg(F.count("*").alias("c")).where(F.col("c") > most).select("k", "x")
    heads = first.where("p <= probe")
    second = first.select(F.col("k").alias("k2"), F.col("a").alias("a2"), F.col("x").alias("y"), F.col("p").alias("p2"))
    # (lists by one word, with its place; those of hot words by two, with the second one's place and how many come with it)
    cold = heads.join(hot, ["k", "x"], "left_anti").select("k", F.array("x").alias("x"), "a", "n", "p", "index", F.lit(1).alias("found"))
    both = heads.join(hot, ["k", "x"], "left_semi").join(second, (F.col("k") == F.col("k2")) & (F.col("a") == F.col("a2")) & (F.col("p2") > F.col("p")))
    lists = cold.unionByName(both.select("k", F.array("x", "y").alias("x"), "a", "n", F.col("p2").alias("p"), (F.col("index") + 1).alias("index"), F.lit(2).alias("found")))
    left = lists.where("p <= index").drop("index")
    right = lists.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("a").alias("b"), F.col("n").alias("n2"), F.col("p").alias("q"))
    smaller = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("a") < F.col("b")))
    needed = F.ceil((F.col("n") + F.col("n2")) * (ALIKE / (100 + ALIKE)) - 1e-9)
    enough = F.col("found") + F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("q")) >= needed
    met = left.join(right, (F.col("k") == F.col("k2")) & (F.col("x") == F.col("x2")) & smaller & (F.col("n") * 100 >= ALIKE * F.col("n2")) & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def word_edges(postings: DataFrame) -> DataFrame:
    """a, b (ord): postings of one normalised company and title whose word sets are alike.

    Only keys of several postings have their texts parted. Equal word sets are one node, by a star to the first; of the
    different ones only candidates() are compared, so a title that is reposted thousands of times with other texts is
    not paired with itself.
    """
    company, title = T.normal_text("company"), T.normal_title("title")
    key = F.when((company != "") & (title != ""), F.sha2(F.concat_ws("\u0001", company, title), 256))
    keys = cut(postings.select("ord", key.alias("k")).where("k is not null"))
    several = keys.groupBy("k").agg(F.count("*").alias("_n")).where("_n > 1").select("k")
    some = keys.join(several, "k", "left_semi").select(F.col("ord").alias("_o"), "k")
    df = postings.select("ord", "description").join(some, F.col("ord") == F.col("_o"))
    df = df.select("ord", "k", F.array_sort(F.array_distinct(F.split(T.normal_text("description"), " "))).alias("w")).where("w[0] <> ''")
    df = cut(df.select("ord", "k", "w", F.sha2(F.array_join("w", " "), 256).alias("_h")))
    first = df.groupBy("k", "_h").agg(F.min("ord").alias("a"), F.first("w").alias("w"))
    of = first.select(F.col("k").alias("_k2"), F.col("_h").alias("_h2"), "a")
    star = df.select("k", "_h", F.col("ord").alias("b")).join(of, (F.col("_h") == F.col("_h2")) & (F.col("k") == F.col("_k2"))).where("a <> b").select("a", "b")
    node = cut(first.select("k", "a", "w", F.size("w").alias("n")))
    pairs = candidates(node, LISTED)
    left, right = node.select(F.col("a").alias("a1"), F.col("w").alias("w1")), node.select(F.col("a").alias("b1"), F.col("w").alias("w2"))
    met = pairs.join(left, F.col("a") == F.col("a1")).join(right, F.col("b") == F.col("b1"))
    met = met.where(F.size(F.array_intersect("w1", "w2")) * 100 >= ALIKE * F.size(F.array_union("w1", "w2"))).select("a", "b")
    return star.unionByName(met)


def grown_groups(folder: str, ends: DataFrame, edges: DataFrame) -> set[int]:
    """Groups that grow as postings arrive: a store of (node, root) in buckets of the root's hash, into which new nodes and edges are merged.

    ends: node, the new postings; edges: a, b, each with one new end at least. Only the roots of the edges' ends are
    looked up, components are found among those roots alone, and of the store the buckets of groups that change are
    rewritten. Returns these buckets. A run that is repeated changes nothing.
    """
    spark = edges.sparkSession
    there = bucketed.snapshot(spark, folder)
    empty = spark.createDataFrame([], "node long, root long")
    stored = empty if there is None else there.select("node", "root")
    nodes = ends.select("node").unionByName(edges.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    known = cut(nodes.join(stored, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("fresh")))
    of = lambda c: known.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"r{c}"))
    between = edges.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    moved = cut(roots(between).where("node <> root").select(F.col("node").alias("_was"), F.col("root").alias("_now")))
    fresh = known.where("fresh").select("node", "root")
    move = lambda rows: rows.join(moved, F.col("root") == F.col("_was"), "left").select("node", F.coalesce("_now", "root").alias("root"))
    touched = moved.select(F.explode(F.array("_was", "_now")).alias("root")).unionByName(fresh.select("root")).distinct()
    return bucketed.rewritten(spark, folder, touched, lambda rows: move(rows.unionByName(fresh)), empty, key="root")


def repost_groups(postings: DataFrame) -> DataFrame:
    """ord, root: every posting and the first of its group, over both kinds of edges."""
    found = roots(hash_edges(postings).unionByName(word_edges(postings)))
    return postings.select("ord").join(found, F.col("ord") == F.col("node"), "left").select("ord", F.coalesce("root", "ord").alias("root"))


def representatives(postings: DataFrame) -> DataFrame:
    """One row of each group, its first, with the others' URLs, their other places and how many were merged."""
    both = postings.join(repost_groups(postings).withColumnRenamed("ord", "_o"), F.col("ord") == F.col("_o")).drop("_o")
    others = both.where("ord <> root").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ord", "job_url", "location"))).alias("_d"))
    others = others.select(F.col("root").alias("_r"), F.transform("_d", lambda x: x["job_url"]).alias("duplicate_job_urls"), F.array_distinct(F.transform("_d", lambda x: x["location"])).alias("_l"))
    first = both.where("ord = root").join(others, F.col("ord") == F.col("_r"), "left")
    place = F.filter("_l", lambda x: x.isNotNull() & (x != "") & ~x.eqNullSafe(F.col("location")))
    return first.withColumn("duplicate_locations", F.when(F.size(place) > 0, place)).withColumn("merged", F.coalesce(F.size("duplicate_job_urls"), F.lit(0))).drop("_r", "_l", "root")


def collapsed(rows: DataFrame, *key: str) -> DataFrame:
    """The first row (by ord) of each key, with repost_count."""
    by = Window.partitionBy(*key)
    return rows.withColumn("repost_count", F.count("*").over(by)).withColumn("_k", F.row_number().over(by.orderBy("ord"))).where("_k = 1").drop("_k")
