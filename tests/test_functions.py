import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectorized as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, root", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("electrical", "electr"), ("hopefulness", "hope"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("by", "by"), ("UTC", "utc")])
def test_stem(word, root):
    assert V.stem(word) == root


@pytest.mark.parametrize("sentence, keywords, hits", [
    ("You will be working here", ["work"], ["work"]), ("A framework", ["work"], []), ("Across time zones", ["time zone"], ["time zone"]), ("We work on site", ["on-site"], ["on-site"]),
    ("Hours in CET", ["CET"], ["CET"]), ("dans cet esprit", ["CET"], []), ("100% remote, C++", ["100%", "C++"], ["100%", "C++"]), ("C++11", ["C++"], []), ("en télétravail", ["télétravail"], ["télétravail"]), ("x", ["--"], []),
])
def test_keywords(sentence, keywords, hits):
    assert V.Keywords(keywords).hits(sentence) == hits


def test_stems_begin_like_their_words():
    """What the keyword search leans on when it passes over sentences."""
    words = "relational conformably digitizer hopefulness electricity sensibility happiness ponies skies flies dying tried fitted vietnamization operator decisiveness adjustable replacement conflated hopping filing agreed national rationalize".split()
    assert all(w.startswith(V.stem(w)[: max(1, len(V.stem(w)) - 2)]) for w in words)


@pytest.mark.parametrize("body, want", [
    ("**Nasdaq AI**\n, a platform. Second one here!\n- bullet point\n1. numbered item\nab", ["Nasdaq AI, a platform.", "Second one here!", "bullet point", "numbered item"]),
    ("One line\n***\n, goes on", ["One line, goes on"]), ("\n, first line", [", first line"]), ("a\n\n\n  ) b\ncloses it", ["a) b", "closes it"][1:]), (None, []), ("", []), ("#" * 5000 + "\n" * 5000 + "title here", ["title here"]),
])
def test_sentences(spark, body, want):
    assert one(spark, T.sentences("a"), a=body) == want


def test_blocks():
    keywords = V.Keywords(["remote"])
    body = ["no", "a remote job", "more", "far", "far2"]
    got = V.blocks(body, [keywords.hits(x) for x in body], {"remote": 0})
    assert [(b["s_id"], b["matched"]) for b in got] == [("S0", False), ("S1", True), ("S2", False)]
    assert V.blocks([], [], {"x": 0}) == []


@pytest.mark.parametrize("title, body, dropped", [
    ("PM", "Fluent German is required.", True), ("German-speaking PM", "", True), ("PM", "German is a plus.", False), ("PM", "Fluent in German or English.", False),
    ("PM", "Knowledge of the German market is required.", False), ("PM", "You must polish the roadmap", False), ("PM", "Dutch (C1)", True), ("PM", "knowledge of Dutch", True), ("PM", "Dutch. You must run", False), ("PM", "must " + "x" * 60 + " Dutch", False), (None, None, False),
])
def test_language_requirement(spark, title, body, dropped):
    assert bool(one(spark, T.requirement("t", "b", ["English"]), t=title, b=body)) is dropped
    assert one(spark, T.requirement("t", "b", []), t=title, b=body) == ""


def test_detector_and_objects():
    detect = V.detector()
    assert detect("the house of the rising sun is in the city") == "en" and detect("le chat et la souris dans les champs") == "fr" and detect("12345") == ""
    assert V.first_object('So: {"a": 1} and {b}') == '{"a": 1}' and V.first_object('```json\n{"a": {"b": 2}}\n```') == '{"a": {"b": 2}}'
    assert V.first_object("none") is None and V.first_object(None) is None


def test_column_functions(spark):
    assert one(spark, T.clean_sentence("a"), a=r"## **Bold** \- text __x__ *") == "Bold - text x"
    assert one(spark, T.normal_title("a"), a="<b>Sr.</b> Mgr_ops") == "senior manager ops"
    assert one(spark, T.norm("a"), a="Product Manager (m/w/d), Zürich") == "product manager z rich"
    assert one(spark, T.company_key("a"), a="ACME Labs GmbH & Co. KG") == "acme labs kg"
    assert one(spark, T.slugs("a"), a="Acme Labs") == ["acme-labs", "acmelabs", "acme"]
    assert one(spark, T.slugs("a"), a="!!") == []
    assert one(spark, T.url_hash(F.col("a")), a="\n HTTPS://X.com/1 ") == one(spark, T.url_hash(F.col("a")), a="https://x.com/1")
    assert one(spark, T.language_codes(F.array(F.col("a"), F.lit("zh-cn"), F.lit("Elvish"))), a=" French") == ["fr", "zh"]
    assert one(spark, T.run_stamp("a"), a="2024-01-01T00:00:00+00:00") == "2024-01-01T00-00-00-00-00"
    for url, want in (("https://boards.greenhouse.io/embed/job_board?for=acme", ("greenhouse", "acme")), ("https://jobs.eu.lever.co/acme/1", ("lever_eu", "acme")), ("https://x.jobs.personio.de/job", ("personio", "x.jobs.personio.de")), ("https://jobs.lever.co/api", None), (None, None)):
        assert one(spark, T.board_from_url("a"), a=url) == want


@pytest.mark.parametrize("quote, body, found", [("fully remote", "This is **fully** remote work", True), ("this ... work", "This is fully remote work", True), ("work ... this", "this is work", False), ("", "x", False), ("...", "x", False), ("It’s “fine”", "it's \"fine\" now", True), ("straße", "STRASSE", True), ("oﬃce", "the OFFICE", True), ("ſet", "set", True), ("a", None, False), (None, "a", False)])
def test_quote_in_text(spark, quote, body, found):
    assert one(spark, T.quote_in_text("q", "b"), q=quote, b=body) is found


def test_entities_with_and_without_a_semicolon(spark):
    raw = "A&eacute;&#39;&#x41;&amp;lt;b&amp;gt; R&D &amp</b> &copy 1 &nothing; &notit;"
    got = spark.createDataFrame([(raw,), (None,)], "raw string").select(T.plain("raw", V.html_unescape).alias("all"), T.plain("raw", V.html_unescape_closed).alias("closed")).collect()
    assert got[0].all == "Aé'A\n R&D &\n © 1 ¬hing; ¬it;"
    assert got[0].closed == "Aé'A\n R&D &amp\n &copy 1 &nothing; &notit;"
    assert tuple(got[1]) == ("", "")
