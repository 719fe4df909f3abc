"""The pipeline: each stage on the fixture's odd rows, and the whole on the small tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestrata.llm import shared

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = shared.keep(stage(spark, docs, FOLDER), "stage")
        seen.append((name, docs.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality classifier":
            bad = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0")
            assert docs.join(bad, "doc_id").count() <= 0.1 * bad.count()
        if name == "simhash near-dedup":
            assert docs.groupBy("text").count().where("count > 1").count() == 0
        if name == "secret scans":
            assert docs.count() == before.count() and docs.where("text rlike 'token *[=] *\"?[0-9a-f]{40}'").count() == 0
        if name == "source mixing":
            size = lambda df: Counter({r.source: sum(len(WORD.findall(t)) for t in r.t) for r in df.groupBy("source").agg(__import__("pyspark").sql.functions.collect_list("text").alias("t")).collect()})
            assert sum(size(docs).values()) == pytest.approx(1.5 * sum(size(before).values()), rel=0.1)
    one = docs.first()
    assert len(one.ids) == one.length and zlib.crc32(np.array(one.ids, "<u4").tobytes()) == one.ids_crc32
    assert seen[0][1] > 100 and docs.agg({"sequence_id": "max"}).first()[0] >= 0


def test_run_is_repeatable(spark):
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(corpus_pipeline.run(spark, FOLDER))


@pytest.mark.parametrize("stage", range(5))
def test_empty_and_odd(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    f = corpus_pipeline.STAGES[stage][1]
    assert f(spark, spark.createDataFrame([], schema), FOLDER).count() == 0
    text = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, None, None, None, None, "x", 1), (1, "", "en", None, 0, "x", 1), (1, "", "en", None, 0, "x", 1), (2, text, "en", "a", len(text), "x", 1), (3, text + " token = abcdefgh1234", "en", "a", 1, "x", 1)]
    odd = spark.createDataFrame(rows, schema + ", _t string, place int")
    out = f(spark, odd, FOLDER)
    got = sorted(out.collect(), key=repr)
    if stage < 4:
        assert out.columns == odd.columns and {(r._t, r.place) for r in got} <= {("x", 1)}
    ids = Counter(r.doc_id for r in got)
    if stage == 0:
        assert ids[1] in (0, 2) and ids[2] == ids[3]
    if stage == 1:
        assert ids == {1: 1, 2: 1}  # all without words are copies of each other, and so are the long ones
    if stage == 2:
        assert len(got) == 5 and [r.text for r in got if r.doc_id == 3][0].endswith("[secret]") and [r.text for r in got if r.doc_id == 2] == [text]
    if stage == 3:
        assert not ids[1] and not ids[None] and 2 <= ids[2] + ids[3] <= 4
    if stage == 4:
        assert ids[None] == 1 and ids[1] == 2 and {r.length for r in got if r.doc_id in (None, 1)} == {1} and all(len(r.ids) == r.length for r in got)
        assert sum(r.length for r in got if r.doc_id == 2) > 30_000
