"""Functions, graph kernels, sources, sinks, grounding and streams on hand-made cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import extraction as X
from lodestrata.functions import parsing as P
from lodestrata.functions import text as TX
from lodestrata.operators import graph as G
from lodestrata.operators import grounding, ranking
from lodestrata.sources import readers, writers
from lodestrata.streaming import windows


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_parsing(spark):
    L = F.lit  # noqa: N806
    assert one(spark, P.money(L("200,000,000")), P.money(L("")), P.money(L(None).cast("string")), P.money(L("x"))) == (2e8, None, None, None)
    got = one(spark, *[P.moment(L(x)) for x in ("2024-12-20T00:00:00Z", "2024-12-22 00:00:00.0", "12/20/2025 12:00:00 AM", "soon")])
    assert [g and g.date().isoformat() for g in got] == ["2024-12-20", "2024-12-22", "2025-12-20", None]
    js = L('{"a":{"b":[{"c":1},{"c":2}]}}')
    assert one(spark, *[P.json_path(js, L(p)) for p in ("a.b[0].c", "a.b[1].c", "a.b[2].c")]) == ("1", "2", None)
    assert one(spark, P.millions_to_usd(L("1,100.00")), P.repaired_json(L('so: {"a": 1}.')), P.repaired_json(L("no")), P.first_of(L('["x","y"]')), P.first_of(L("z"))) == ("1,100,000,000", '{"a": 1}', None, "x", "z")


def test_text(spark):
    L = F.lit  # noqa: N806
    assert one(spark, TX.digit_ratio(L("")), TX.alpha_ratio(L("aé1 ")), TX.supports(L("a  b\nc"), L("b c")), TX.coherence(L("")), TX.padded(F.array(L(1), L(2)), 4)) == (0.0, 0.5, True, 0.0, [1, 2, 0, 0])
    assert one(spark, TX.letters_only(L("<b>Été</b> 12 ok")), TX.without_marks(L("a-b, 3 C")))[1] == "ab  c"


def test_extraction(spark):
    L = F.lit  # noqa: N806
    page = "Total Operation Cost 1,100.00\nTotal: 1.0 2.0 3.5\nCountry\nTogo\nOriginal PDO\nto help\nmany\nRevised PDO\n• Roads built (km, yearly)\nValue 1.0 2.0 30.0 40.0\n"
    got = one(spark, X.amount(L(page), "total_cost"), X.third_amount(L(page), "Total"), X.after_label(X.lines_of(L(page)), "country"), X.between(L(page), "original pdo", "revised pdo"), X.rating(L("● Moderately   Satisfactory")))
    assert got == ("1,100,000,000", "3,500,000", "Togo", "to help many", "Moderately Satisfactory")
    ind = one(spark, X.indicators(L(page)))[0]
    assert [(i.name, i.unit, i.baseline, i.achieved, i.target) for i in ind] == [("Roads built", "km", 1.0, 30.0, 40.0)]


def toy(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0, 1.0) for a, b in pairs], "src int, dst int, cond double, cost double")


def test_graph_closed_forms(spark):
    path = toy(spark, [(i, i + 1) for i in range(9)])
    m = {r.node: r for r in G.node_metrics(path).collect()}
    assert m[0].kbar == pytest.approx(11 / 3, abs=1e-6) and m[0].cf_closeness == pytest.approx(1 / 45) and m[5].degree == 2
    assert m[1].betweenness == pytest.approx(8 / 36)
    star = toy(spark, [(0, i) for i in range(1, 10)])
    r = {x.node: x for x in G.removal_impact(star, G.degrees(star)).collect()}
    assert r[0].delta_conn_pairs == pytest.approx(1.0) and r[0].delta_eff == pytest.approx(0.6) and r[0].delta_aspl is None and r[0].articulation and not r[1].articulation
    bridge = toy(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)])
    r = {x.node: x for x in G.removal_impact(bridge, G.degrees(bridge)).collect()}
    m = {x.node: x for x in G.node_metrics(bridge).collect()}
    assert m[2].betweenness == pytest.approx(0.6) and r[2].delta_conn_pairs == pytest.approx(0.6) and r[2].delta_eff == pytest.approx(0.28889, abs=1e-5)
    g = G.Graph([(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.0)])
    assert np.allclose(g.resistance(), [[0, 1, 2], [1, 0, 1], [2, 1, 0]]) and G.pair_fraction([1]) == 1.0


def test_rank_ties_and_constants(spark):
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(5)] + [("b", 1.0, float(i)) for i in range(4)] + [("a", float("nan"), 1.0)], "g string, x double, y double")
    got = {r.g: (r.rho, r.n) for r in ranking.spearman(df, "x", "y", ["g"]).collect()}
    assert got["a"] == (pytest.approx(1.0), 5) and got["b"] == (None, 4)


def test_grounding(spark):
    facts = spark.createDataFrame([("p", "a", "number", "1", []), ("p", "b", "text", "x", None), ("p", "c", "text", "x", [("k", "in  the")]), ("p", "d", "date", "2020", [("k", "in the"), ("k", "not")]), ("p", "e", "number", None, None)], "project_id string, field_path string, kind string, value string, citations array<struct<chunk_id string, quote string>>")
    chunks = spark.createDataFrame([("k", "it is in\nthe text")], "chunk_id string, text string")
    got = {(r.severity, r.issue_type, r.field_path) for r in grounding.issues(facts, chunks).collect()}
    assert got == {("error", "unsupported_numeric_or_date", "a"), ("warn", "missing_citation", "b"), ("error", "citation_not_supported", "d.citations[1]")}
    assert {r.field_path for r in grounding.unconfirmed(grounding.issues(facts, chunks)).collect()} == {"a", "d"}
    gold = spark.createDataFrame([("p", "x", "number", "1,000"), ("p", "y", "date", "2024"), ("p", "z", "string", None), ("q", "x", "number", None)], "project_id string, field_path string, value_type string, value string")
    runs = spark.createDataFrame([("p", '{"x": 1000.0, "y": 2024}')], "project_id string, output_json string")
    assert tuple(grounding.gold_accuracy(gold, runs).first()) == (4, 2, 0.5)


def test_sources_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    writers.write_version(df, root, "silver", "t", "v1")
    writers.write_version(df, root, "silver", "t", "v2")
    writers.write_version(df.limit(1), root, "silver", "t", "v2")
    writers.append_version(spark.createDataFrame([(3, "c")], "id long, v string"), root, "silver", "t", "v1")
    assert readers.versioned(spark, root, "silver", "t", "v1").count() == 3 and readers.versioned(spark, root, "silver", "t", "v2").count() == 1
    writers.write_manifest(df, root, "v1", "select", n=2)
    writers.write_manifest(df, root, "v1", "process", n=3)
    assert spark.read.parquet(f"{root}/manifests").count() == 2
    writers.write_csv(df, f"{root}/csv")
    schema = T.StructType.fromDDL("id int, v double")
    assert readers.typed_csv(spark, f"{root}/csv", schema, ["id"]).count() == 2 and readers.typed_csv(spark, f"{root}/csv", schema, ["v"]).count() == 0
    with pytest.raises(ValueError):
        readers.typed_csv(spark, f"{root}/csv", T.StructType.fromDDL("zz int"), [])
    (tmp_path / "l.json").write_text(json.dumps([{"id": 1, "v": "x"}, {"id": 2}]))
    (tmp_path / "l.jsonl").write_text('{"id": 1, "v": "x"}\n\n{"id": 2}\n')
    (tmp_path / "bad.json").write_text("{[")
    assert readers.json_list(spark, f"{root}/l.json", "id int, v string").count() == 2
    assert readers.json_list(spark, f"{root}/bad.json", "id int, v string").count() == 0 and readers.json_list(spark, f"{root}/none.json", "id int, v string").count() == 0
    assert readers.json_lines(spark, f"{root}/l.jsonl", "id int, v string").count() == 2
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/a.txt").write_bytes(b"one\ntwo")
    (tmp_path / "bin/b.txt").write_bytes(b"\xff")
    rows = readers.binary_files(spark, f"{root}/bin", lambda b: [{"page": i, "text": t} for i, t in enumerate(b.decode().split("\n"), 1)], "page int, text string").collect()
    assert len(rows) == 3 and sum(r.error is not None for r in rows) == 1
    (tmp_path / "p0.json").write_text(json.dumps({"d": {"k": {"id": 1}, "j": {"id": 2}}}))
    (tmp_path / "p1.json").write_text(json.dumps({"d": {}}))
    spark.dataSource.register(readers.PagedJson)
    assert spark.read.format("paged_json").option("url", f"file://{root}/p{{page}}.json").option("pages", 2).option("items", "d").load().count() == 2
    first = readers.first_wins(df.withColumn("seq", F.lit(1)), df.withColumn("v", F.lit("z")).withColumn("seq", F.lit(0)), ["id"], "seq")
    assert {r.query_mode for r in first.collect()} == {"precise"}
    assert writers.json_export(df, "v", "a").first().json == '{"total":2,"positive":1,"negative":1}'
    assert df.select(writers.markdown("R", [("v", F.col("v")), ("n", F.lit(None))]).alias("m")).first().m == "# R\n- **v:** a\n- **n:** Not confirmed"


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    typed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    typed.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windows.landed(spark, str(tmp_path / "in"), typed.schema.simpleString()[7:-1].replace(":", " "))
    q = windows.counted(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()
    assert windows.sessions(typed).agg(F.sum("n")).first()[0] == events.count()


def test_padded_index_keeps_rare_words(spark):
    from lodestrata.plans.documents import padded_index

    word = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "z"
    texts = [(1, " ".join(word(i) for i in range(700))), (2, " ".join(word(i) for i in range(640))), (3, word(690)), (4, "")]
    got = {r.doc_id: r for r in padded_index(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4} and all(len(r.ids) == 300 for r in got.values())
    assert got[3].n == 1 and got[3].ids[0] > 0 and not any(got[3].ids[1:]) and got[4].n == 0 and not any(got[4].ids)
    assert got[1].n == 300 and len(set(got[1].ids)) == 300
