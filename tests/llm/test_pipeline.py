from collections import Counter

import pytest
from cases import SCHEMA, clashing, documents

import __spark_entry__
import corpus_pipeline
from tidebook.llm import jaccard_join, packing, pipeline, queries

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name == "near_duplicates":
            groups = jaccard_join.join_components(before, 80, 5)
            assert kept[name] == groups.select("component_id").distinct().count() == docs.select("doc_id").distinct().count()
        if name != "packing":
            assert docs.columns == COLUMNS
    assert kept["language"] > 0.95 * n and kept["toxicity"] > 0.8 * n
    pieces = docs.groupBy("doc_id").agg({"length": "sum"}).count()
    assert pieces == before.select("doc_id").distinct().count()


def test_pipeline_is_registered(spark, sf):
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run is pipeline.run
    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.ORACLE_SQL is None
    out = pipeline.run(spark, sf)
    assert out.columns == [c.split()[0] for c in packing.OUT.split(", ")]
    assert [q for q in __spark_entry__.queries() if q.startswith("op")] == [q for q in queries.QUERIES if q.startswith("op")]


WORDS = "these are some plain words of document number {} and they go on for a while so that it is long enough"
ROWS = [(i, WORDS.format(f"n{i} with m{i} or k{i}"), "en", "s", 10) for i in range(12)] + [
    (None, "a row without number stays in as it is like no other", "en", None, 1), (None, WORDS.format("n3 with m3 or k3"), "en", "t", 1), (50, None, "en", "s", 0),
    (3, WORDS.format("n3 with m3 or k3"), "fr", "s", 10), (7, "quite another text under a number that is taken by one before it", "en", "s", 9), (-4, "a text of its own under a number below zero", "en", "s", 9),
]


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_lose_no_text(spark):
    """Rows of one doc_id with different texts stay, copies go whatever their doc_id."""
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = texts(pipeline.near_duplicates(spark, docs, ""))
    assert {t for _, t in got} == {r[1] for r in ROWS} and max(got.values()) == 1
    assert (3, WORDS.format("n3 with m3 or k3")) in got and (None, WORDS.format("n3 with m3 or k3")) not in got
    assert got[7, ROWS[7][1]] == got[7, ROWS[-2][1]] == got[50, None] == 1
    for ids in (None, 5):
        same = spark.createDataFrame([(ids, *r[1:]) for r in ROWS], SCHEMA)
        assert {t for _, t in texts(pipeline.near_duplicates(spark, same, ""))} == {r[1] for r in ROWS}


def test_mixing_repeats_rows_by_their_words(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = texts(pipeline.mixed(spark, docs, ""))
    assert set(got) <= {r[:2] for r in ROWS} and (50, None) not in got and max(got.values()) <= 6
    same = spark.createDataFrame([(None, *r[1:]) for r in ROWS], SCHEMA)
    taken = {r["text"]: r["taken"] / r["size"] for r in pipeline.mixing.mix(pipeline.numbered(same).drop("doc_id").withColumnRenamed("id", "doc_id").drop("source").withColumnRenamed("lang", "source")).withColumnRenamed("doc_id", "id").join(pipeline.numbered(same).select("id", "text"), "id").collect() if r["size"]}
    assert all(0 <= x <= 3 for x in taken.values())


@pytest.mark.parametrize("name,stage", pipeline.STAGES[:4])
def test_stages_take_odd_rows(spark, sf, name, stage):
    docs = documents(spark)
    got = stage(spark, docs, sf)
    assert got.columns == COLUMNS
    assert texts(stage(spark, clashing(docs), sf)) == texts(got)
    assert stage(spark, docs.limit(0), sf).count() == 0
    assert set(texts(got)) <= set(texts(docs))
