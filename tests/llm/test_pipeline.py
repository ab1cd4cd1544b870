"""The pipeline end to end on the smallest table, each stage against what it must keep."""

import os

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import DDL, corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
    assert 0 < sizes[2] < sizes[1] < sizes[0] and sizes[3] == sizes[2] and sizes[4] > 0
    packed = docs.groupBy("sequence_id").sum("length").toPandas()
    assert packed["sum(length)"].max() <= 2048
    assert corpus_pipeline.run(spark, DATA).count() == sizes[-1]


#: Names that the stages' joins use themselves, or might.
CLASHING = ("_id", "_th", "_h", "_n", "_s", "_k", "_host", "_copy", "_rows", "_text", "_spans", "doc", "key", "th", "left", "removed_lines", "component_id", "copies", "taken", "shard", "g", "piece", "_key")


def awkward(spark):
    """The corpus of the operators' tests (nulls, empties, ties, repeats, a long text) with columns of clashing names."""
    docs = spark.createDataFrame(corpus(), DDL).repartition(3)
    return docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHING}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_awkward_rows(spark, name, stage):
    docs = awkward(spark)
    rows = stage(spark, docs, DATA).collect()
    none = stage(spark, docs.limit(0), DATA)
    assert none.count() == 0
    if name == "packing":
        assert len({r["doc_id"] for r in rows}) == len({r[0] for r in corpus()}) and sum(r["piece"] == 0 for r in rows) == len(corpus())
        return
    assert none.columns == docs.columns and rows
    for r in rows:
        assert all(r[c] == f"{c}:{'null' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING) and r["m"] == {"a": 1}
    texts, ids = {d[0]: d[1] for d in corpus()}, sorted(str(r["doc_id"]) for r in rows)
    if name == "quality rules":
        assert not {"3", "4", "5", "6", "7"} & set(ids) and ids.count("9") == 2  # no words; repeated rows are judged alike
    if name == "n-gram Jaccard join":
        assert {"0", "3", "4", "5", "6"} <= set(ids) and not {"1", "7"} & set(ids) and ids.count("9") <= 1
    if name == "PII":
        assert ids == sorted(str(d[0]) for d in corpus()) and all(r["text"] == texts[r["doc_id"]] for r in rows if r["doc_id"] != 9)
    if name == "mixing":
        assert not {"3", "4", "5"} & set(ids)
