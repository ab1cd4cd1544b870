"""The trained language detector and the keyword automata, against brute force and held-out texts."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import language, profiles
from tessera.functions.vectorized import Keywords
from tessera.operators import stage0
from tessera.plans import registry

DATA = "/root/testdata/sf0.1"


def bucket(gram):
    return (sum(ord(c) * f for c, f in zip(gram, language.FACTORS)) + len(gram) * language.LENGTH_FACTOR) % language.BUCKETS


def grams(text):
    t = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    return Counter(bucket(t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1))


def test_scores_against_counting(spark):
    rng = random.Random(1)
    letters = {"aa": "abcdefgh ", "bb": "fghijklm ", "cc": "klmnopäß "}
    rows = [(lang, "".join(rng.choice(x) for _ in range(200))) for lang, x in letters.items() for _ in range(5)]
    table = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    langs, steps = language.weights(language.profiles(table))
    assert langs == ["aa", "bb", "cc"]
    counts = {lang: sum((grams(t) for x, t in rows if x == lang), Counter()) for lang in langs}
    step = lambda lang, b: math.floor(math.log((counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * language.BUCKETS)) * 1024 + 0.5)
    asked = ["".join(rng.choice("abcdefghijklmnopäß .1") for _ in range(rng.randrange(20, 90))) for _ in range(40)]
    wanted = {}
    for t in asked:
        scores = {lang: sum(n * step(lang, b) for b, n in grams(t).items()) for lang in langs}
        wanted[t] = max(langs, key=lambda x: (scores[x], x))
    got = spark.createDataFrame([(t,) for t in asked], "t string").repartition(3).select("t", language.detector((langs, steps))("t").alias("d")).collect()
    assert {r.t: r.d for r in got if len(r.t.strip()) >= 20} == {t: d for t, d in wanted.items() if len(t.strip()) >= 20}


def test_awkward_texts(spark):
    model = language.weights(language.profiles(spark.createDataFrame([("en", "the cat and the dog " * 9), ("de", "der hund und die katze " * 9), (None, "x" * 90), ("fr", None), ("fr", "court")], "lang string, text string")))
    assert model[0] == ["de", "en"]
    texts = [None, "", "too short", "1234567890 " * 9, "the dog and the cat " * 30_000, " " * 90, "die katze und der hund"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", language.detector(model)("t").alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [None, None, None, None, "en", None, "de"]
    nothing = language.weights(language.profiles(spark.createDataFrame([], "lang string, text string")))
    assert spark.createDataFrame([("a text of some length",)], "t string").select(language.detector(nothing)("t").alias("d")).first().d is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    found = registry.t19_languages(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").where("length(trim(text)) >= 20 and lang is not null").select("doc_id"), "doc_id").where("held_out")
    right, n = found.agg(F.count_if(F.expr("lang = detected")), F.count("*")).first()
    assert n > 1000 and right >= 0.97 * n


def test_funnel_drops_by_the_detector(spark):
    model = language.weights(language.profiles(spark.createDataFrame([("en", "we build a prototype with care and ship it " * 9), ("de", "wir bauen einen prototype mit viel sorgfalt " * 9)], "lang string, text string")))
    data = [(1, "we ship a prototype with care"), (2, "wir bauen einen prototype mit sorgfalt"), (3, "prototype"), (4, None)]
    posts = spark.createDataFrame([(i, f"u{i}", "Lead", "A", "x", t) for i, t in data], "ord long, job_url string, title string, company string, location string, description string")
    got = stage0.waterfall(posts, ["en"], ["prototype"], [], detect=language.detector(model))
    assert {r.ord: r.drop_reason for r in got.collect()} == {1: None, 2: "language", 3: None, 4: "no_tier1_hit"}


WORDS = "run runs running licence MIT mit team-work c++ c# node.js stone stones über café a_b 12 in_word".split()


def test_automata_against_single_keywords():
    rng = random.Random(4)
    keywords = list(dict.fromkeys(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(120))) + ["", "...", "C++", "MIT"]
    automata, one = profiles.Automata(dict(enumerate(keywords))), [Keywords([k]) for k in keywords]
    for _ in range(300):
        text = "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", " ", ", ", "-", "_", ""]) for w in rng.choices(WORDS, k=12))
        lines = [text[:40], "", text[40:], text]
        wanted = {n: [i for i, line in enumerate(lines) if k.hits(line)] for n, k in enumerate(one)}
        assert automata.hits("\n".join(lines)) == {n: at for n, at in wanted.items() if at}, text
    assert profiles.Automata({}).hits("nothing to find") == {}


def test_profile_screen(spark):
    posts = spark.createDataFrame([(0, "We love prototypes here. Nothing more. Again a prototype now! The end of it."), (1, "MIT people wanted."), (2, None), (3, "")], "ord long, description string")
    keywords = spark.createDataFrame([("p", 1, "prototype"), ("p", 2, "end"), ("q", 1, "MIT"), ("q", 2, "prototype"), ("q", 3, "prototype"), ("r", 1, "absent"), ("r", 2, None)], "profile_id string, place int, keyword string")
    got = sorted(tuple(r) for r in stage0.profile_screen(posts, keywords).collect())
    assert got == [("p", 0, ["prototype", "end"], 3, 4), ("q", 0, ["prototype"], 2, 4), ("q", 1, ["MIT"], 1, 1)]
    assert stage0.profile_screen(posts.limit(0), keywords).count() == stage0.profile_screen(posts, keywords.limit(0)).count() == 0
