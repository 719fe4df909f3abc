"""Closed forms and odd rows of records, reviews, models, graphs apart, and sources that fail."""

import io
import math
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import documents as D
from lodestrata.operators import graph as G
from lodestrata.operators import models as M
from lodestrata.operators import ranking as R
from lodestrata.operators import records as X
from lodestrata.operators import review as V
from lodestrata.sources import graphs, readers, writers
from lodestrata.streaming import windows


def toy(spark, edges):
    return spark.createDataFrame([(a, b, 1.0, 1.0) for a, b in edges], "src long, dst long, cond double, cost double")


def test_graphs_apart(spark):
    two = toy(spark, [(0, 1), (2, 3)])
    r = {(x.src, x.dst): x.resistance for x in G.resistances(two).collect()}
    assert r[(0, 1)] == pytest.approx(1) and r[(2, 3)] == pytest.approx(1) and r[(0, 2)] == r[(1, 3)] == 40
    g = G.Graph([(0, 1, 1.0, 1.0), (2, 3, 1.0, 1.0)])
    assert g.kbar() == pytest.approx((2 * 2 + 8 * 40) / 12) and g.kbar(penalty=7) == pytest.approx((4 + 56) / 12)
    assert [x.component for x in G.component_labels(two).orderBy("node").collect()] == [0, 0, 2, 2]
    m = {x.node: x for x in G.node_metrics(two).collect()}
    assert m[0].kbar == pytest.approx(1) and m[2].cf_closeness == 0 and m[0].cf_closeness == pytest.approx(1)
    star = toy(spark, [(0, i) for i in range(1, 5)])
    r = {x.node: x.resk for x in G.removal_impact(star, G.removal_nodes(star)).collect()}
    assert r[0] == pytest.approx(10 * 1 * 4 - 1.6) and r[1] == pytest.approx(1.5 - 1.6)  # no edge is left: the penalty; a smaller star
    assert G.efficiency(star).first().efficiency == pytest.approx((8 * 1 + 12 * 0.5) / 20)
    whole = {x.node: x.betweenness for x in G.node_metrics(star, [0, 1, 2, 3, 4]).collect()}
    assert whole[0] == pytest.approx(1) and whole[1] == 0
    assert [x.node for x in G.removal_nodes(star, "top_degree_k", 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        G.removal_nodes(star, "none")
    arcs = G.with_costs(G.ring(spark, 20, 5))
    rows = arcs.collect()
    assert 20 <= len(rows) <= 25 and all(1 <= x.cost <= 10 for x in rows) and sorted(map(tuple, G.with_costs(G.ring(spark, 20, 5)).collect())) == sorted(map(tuple, rows))


def test_records(spark):
    df = spark.createDataFrame([(1, "Final PAD for x", None, "Publications & Research"), (2, None, "ISR icr", None), (3, "padding", "Working Paper", None)], "k int, title string, kind string, major string")
    cls = D.document_class(F.col("title"), F.col("kind"), F.col("major"))
    got = df.select(cls.alias("c"), D.document_score(cls, F.lit(True), F.lit(False), F.col("title"), F.col("kind"), F.col("major")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("PAD", 10.0), ("ICR", 25.0), ("OTHER", -4.0)]
    empty = spark.createDataFrame([("{}", "t", "v"), (None, "t", "v"), ('{"id": 7, "totalamt": 0, "totalcommamt": "5"}', "t", "v")], "payload_json string, ingested_at string, dataset_version_id string")
    rows = X.projects(empty).collect()
    assert len(rows) == 1 and rows[0].project_id == "7" and rows[0].total_commitment_usd == 5.0 and len(rows[0]) == 16
    js = spark.createDataFrame([('[{"doc_id": 1, "chunk_id": null, "quote": "q", "x": {"doc_id": "d", "chunk_id": "c", "quote": ""}}]',), ("{",), (None,)], "js string")
    out = js.select(F.inline(D.citations_anywhere(F.col("js")))).collect()
    assert [tuple(r) for r in out] == [("[0]", "1", None, "q"), ("[0].x", "d", "c", "")]
    with pytest.raises(ValueError):
        X.ordered_by(df, {"k": [F.col("k")]}, "other")
    split = X.hash_split(spark.range(20_000), {"a": 0.7, "b": 0.85}, "c", "s", "id").groupBy("split").count().collect()
    assert {r["split"]: round(r["count"] / 20_000, 1) for r in split} == {"a": 0.7, "b": 0.1, "c": 0.1} or all(abs(r["count"] / 20_000 - {"a": 0.7, "b": 0.15, "c": 0.15}[r["split"]]) < 0.02 for r in split)
    item = spark.createDataFrame([([("A", None)], [("b", "%"), ("a", None), ("B", "%")])], "old array<struct<name:string,unit:string>>, new array<struct<name:string,unit:string>>")
    got = item.select(X.merged_items(F.col("old"), F.col("new"), ["name", "unit"]).alias("m"), X.merged_items(F.col("old"), F.lit(None).cast("array<struct<name:string,unit:string>>"), ["name"]).alias("n")).first()
    assert [tuple(x) for x in got.m] == [("A", None), ("b", "%")] and [tuple(x) for x in got.n] == [("A", None)]


def test_reviews(spark):
    v = spark.createDataFrame([("i", 1, "v1", "x", 0.5), ("i", 2, "v2", "y", None)], "image string, version int, version_id string, label string, score double")
    u = spark.createDataFrame([("i", None, 0.9), ("none", "z", 0.1)], "image string, label string, score double")
    assert [tuple(r) for r in V.updated(v, u, "image", ["label", "score"]).collect()] == [("i", "y", 0.9, 3, "v2")]
    e = spark.createDataFrame([(1, "termine", 1), (1, "hospitalise", 2), (2, "unknown", 1), (3, "en_traitement", 1)], "k int, status string, at int")
    assert [r.allowed for r in V.allowed_moves(e, "k", "status", ["at"], "en_traitement", V.STATES).orderBy("k", "at").collect()] == [True, False, False, False]
    assert [r.id for r in V.numbered(spark.range(300).repartition(7), "p", ["id"], 10).orderBy("id").limit(1).collect()] == ["p_100"]
    assert {r.id for r in V.numbered(spark.range(30).withColumnRenamed("id", "n"), "p", ["n"]).collect()} == {f"p_{i}" for i in range(1, 31)}
    runs = spark.createDataFrame([(1, 1, "a", ["x"]), (1, 2, "a", ["x", "y"]), (1, 3, None, []), (2, 1, "a", ["x"])], "p int, s int, a string, names array<string>")
    got = {r.p: r for r in V.stability(runs, "p", "s", ["a"], "names").collect()}
    assert got[1].agreement == 0.5 and got[1].jaccard == 0.25 and got[2].agreement is None


def test_kendall_and_ranks(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(x), float(y)) for g in "ab" for x, y in rng.integers(0, 6, (40, 2))] + [("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    got = {r.g: r for r in R.kendall(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    for g in "ab":
        own = [(x, y) for k, x, y in rows if k == g]
        pairs = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for i, a in enumerate(own) for b in own[:i]]
        want = sum(p * q for p, q in pairs) / math.sqrt(sum(p != 0 for p, _ in pairs) * sum(q != 0 for _, q in pairs))
        assert got[g].tau == pytest.approx(want)
    assert got["c"].tau is None or math.isnan(got["c"].tau)
    n = R.numbered(spark.range(500).repartition(9), [F.desc("id")]).collect()
    assert all(r.place == 500 - r.id for r in n)


def test_models(spark):
    # one event a time: the exact likelihood is the usual one, maximised here on a grid
    rows = [(float(i), 6 - i // 2, 6 - (i + 1) // 2, 1, int(i % 3 == 0)) for i in range(8)]
    m = M.Cox(rows)
    loglik = lambda b: sum(b * dx - math.log(r0 + r1 * math.exp(b)) for _, r0, r1, _, dx in rows)
    best = max(np.arange(-4, 4, 0.001), key=loglik)
    assert m.beta == pytest.approx(best, abs=2e-3) and m.likelihood_ratio()[0] == pytest.approx(2 * (loglik(m.beta) - loglik(0)), abs=1e-6)
    assert m.schoenfeld()[0] >= 0 and 0 <= m.schoenfeld()[1] <= 1
    tied = M.Cox([(1.0, 3, 3, 2, 2), (2.0, 3, 1, 1, 0)])
    b = tied.beta
    w = [math.comb(3, j) * math.comb(3, 2 - j) * math.exp(b * j) for j in range(3)]
    assert tied.loglik == pytest.approx(math.log(w[2] / sum(w)) + math.log(3 / (3 + math.exp(b))))
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(400) > 0).astype(float)
    y[:40] = 1 - y[:40]
    df = spark.createDataFrame([(*map(float, a), float(b), i % 5) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, fold int")
    steps = M.stepwise(df, ["a", "b", "c"], "y", "bic")
    assert steps[-1][2] == ["a"] and [s[3] for s in steps] == sorted([s[3] for s in steps], reverse=True)
    coef = M.lasso(df, ["a", "b", "c"], "y", "fold", grid=(0.1, 0.01)).coefficients.toArray()
    assert abs(coef[0]) > 5 * max(abs(coef[1]), abs(coef[2]))
    table = M.kmeans_table(df, ["a", "b", "c"], range(1, 4), 2)
    assert table[0][1] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and table[0][2] == 0 and table[2][2] == pytest.approx(table[1][2] + table[2][3]) and table[2][1] < table[1][1]
    f = rng.standard_normal((300, 2))
    d = spark.createDataFrame([(float(p), float(p + 0.1 * e), float(q), float(q - 0.1 * e)) for (p, q), e in zip(f, rng.standard_normal(300), strict=True)], "a double, b double, c double, d double")
    load = np.abs(M.factors(d, ["a", "b", "c", "d"], 2))
    assert sorted((load > 0.9).sum(0).tolist()) == [2, 2] and ((load > 0.9) | (load < 0.25)).all()


def test_sources_that_fail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers.time, "sleep", lambda s: waits.append(s))
    waits, calls = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return io.BytesIO(b'{"docs": [{"a": 1}, 5, {"b": 2}]}')

    assert readers.fetched("http://x", opener=opener)["docs"][0] == {"a": 1} and len(waits) == 2 and all(0.2 <= w <= 1 for w in waits)
    with pytest.raises(urllib.error.HTTPError):
        readers.fetched("http://x", opener=lambda u, timeout: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "gone", {}, None)))
    pages = {"0": b'{"r": [{"x": 0}, {"x": 1}]}', "2": b'{"r": [{"x": 2}]}'}
    got = list(readers.paged_rows("{offset}", 2, "r", opener=lambda u, timeout: io.BytesIO(pages[u])))
    assert [p for *_, p in got] == ['{"x": 0}', '{"x": 1}', '{"x": 2}'] and [p for p, *_ in got] == [0, 0, 1]
    assert list(readers.paged_rows("{page}", 2, opener=lambda u, timeout: io.BytesIO(b"[]"))) == []
    assert readers.link_in_page("<p><a href='/a.html'>x</a><a href='/d/b.PDF?v=1'>y</a>", "http://h/p/") == "http://h/d/b.PDF?v=1"

    def files(url, timeout):
        if url.endswith("missing"):
            raise urllib.error.URLError("no")
        return io.BytesIO({"page": b"<html><a href='real.pdf'>", "real.pdf": b"content", "empty": b""}[url.rsplit("/", 1)[1]])

    urls = spark.createDataFrame([("a", "http://h/page"), ("b", "http://h/empty"), ("c", "http://h/missing"), ("d", "http://h/real.pdf")], "id string, url string")
    folder = str(tmp_path / "files")
    for status in ("ok", "exists"):
        rows = {r.id: r for r in readers.downloaded(urls, folder, 2, files, r"\.pdf$").collect()}
        assert [rows[k].status for k in "abcd"] == [status, "empty", "failed", status] and rows["a"].n_bytes == 7
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == ["a", "d"]


def test_made_up_graphs(spark):
    n = graphs.erdos_renyi(spark, 200, 0.1, 3)
    rows = n.collect()
    assert 0.07 < len(rows) / (200 * 199 / 2) < 0.13 and all(0 <= r.src < r.dst < 200 for r in rows) and len(set(rows)) == len(rows)
    assert graphs.erdos_renyi(spark, 5, 1.0).count() == 10 and graphs.erdos_renyi(spark, 5, 0.0).count() == 0
    assert graphs.watts_strogatz(spark, 30, 4, 0.0).count() == 60 and 50 <= graphs.watts_strogatz(spark, 30, 4, 0.3).count() <= 60
    assert graphs.barabasi_albert(spark, 50, 2).count() == 96 and graphs.balanced_tree(spark, 2, 3).count() == 14
    for law in ("lognormal", "uniform", "exponential"):
        c = [r.cost for r in graphs.random_costs(n, law).collect()]
        assert min(c) > 0 and abs(np.median(c) - {"lognormal": 1, "uniform": 1, "exponential": math.log(2)}[law]) < 0.1
    assert np.median([r.cost for r in graphs.random_costs(n, "uniform", by_median=True).collect()]) == pytest.approx(1)
    for name, articulated in {"path_10": 8, "star_10": 1, "two_triangles_bridge": 2, "square_with_diagonals": 0, "two_cliques_two_bridges": 0}.items():
        edges = graphs.toy(spark, name).withColumns({"cond": F.lit(1.0), "cost": F.lit(1.0)})
        assert G.removal_impact(edges, G.removal_nodes(edges)).where("articulation").count() == articulated, name


def test_reports_and_archives(spark, tmp_path):
    import json
    import zipfile

    runs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "project int, model string")
    gold = spark.createDataFrame([(1, "a", 1), (1, "a", 0)], "project int, model string, matched int")
    out = writers.assessment_report(V.assessment(runs, runs.limit(0), gold, "project", "model"), "project", "model").first()
    assert "| all | a | 2 | 0 | 2 | 1 | 50.0 |" in out.markdown and "| 2 | b | 1 | 0 | 0 | 0 | Not confirmed |" in out.markdown
    assert [x.get("project") for x in json.loads(out.json)] == [None, None, 1, 2]
    df = spark.createDataFrame([(1, "train", "x"), (2, "test", "y")], "id int, split string, label string")
    writers.write_labelled(df, str(tmp_path / "set"), "id", "label", str(tmp_path / "set.zip"))
    names = zipfile.ZipFile(tmp_path / "set.zip").namelist()
    assert any(n.startswith("files/split=train/label=x/") for n in names) and any(n.startswith("labels.csv/") for n in names)


def test_late_rows_and_first_seen(spark, tmp_path):
    ts = lambda h, m=0: __import__("datetime").datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, user_id long, event_type string, value double"
    for i, rows in enumerate([[(ts(1), 1, "a", 1.0), (ts(1, 5), 1, "a", 1.0)], [(ts(9), 2, "a", 1.0)], [(ts(1, 30), 3, "a", 1.0), (ts(8, 30), 1, "a", 1.0)], [(ts(20), 4, "a", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            q = windows.counted(windows.landed(spark, str(tmp_path / "in"), schema, 1)).writeStream.format("memory").queryName("late").outputMode("append").start()
            d = windows.first_seen(windows.landed(spark, str(tmp_path / "in"), schema, 1), ["user_id"], late="30 days").writeStream.format("memory").queryName("seen").outputMode("append").start()
        q.processAllAvailable()
        d.processAllAvailable()
    q.stop()
    d.stop()
    got = {(r.start.hour, r.n) for r in spark.table("late").collect()}
    assert got == {(1, 2), (8, 1), (9, 1)}  # the row of 1:30 came after the watermark of 8:00
    assert sorted(r.user_id for r in spark.table("seen").collect()) == [1, 2, 3, 4]


def test_models_of_a_step_share_passes(spark, monkeypatch):
    """Stepwise and LASSO take as many passes for all models as for one, and reach the least: by conditions of NumPy."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 3)) * [1, 5, 1] + [0, 3, 0]
    y = (x[:, 0] - 0.3 * x[:, 1] + rng.standard_normal(600) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b), i % 5) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, fold int")
    passes, own = [], M.totals
    monkeypatch.setattr(M, "totals", lambda *a: passes.append(1) or own(*a))
    monkeypatch.setattr(M.subsets, "totals", lambda *a: passes.append(1) or own(*a))
    steps = M.stepwise_by(df, ["a", "b", "c"], "y", ["aic", "bic"])
    assert len(passes) < 50 and steps["aic"][-1][2][:2] == steps["bic"][-1][2][:2] and set(steps["bic"][-1][2]) == {"a", "b"}
    passes.clear()
    m = M.lasso(df, ["a", "b", "c"], "y", "fold", grid=(0.1, 0.02))
    assert len(passes) < 40 and 0.8 < max(m.area.values()) <= 1
    beta = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + m.intercept)))
    slope = x.T @ (p - y) / 600 / x.std(axis=0, ddof=1)
    assert (p - y).sum() == pytest.approx(0, abs=1e-5)
    assert all(g == pytest.approx(-m.lam * np.sign(b), abs=1e-7) if b else abs(g) <= m.lam for b, g in zip(beta, slope, strict=True))
    assert [r.p for r in df.select(m.probability().alias("p")).collect()] == pytest.approx(p.tolist())


def test_all_starts_share_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (100, 2)) for c in ((0, 0), (5, 5), (0, 9), (9, 0))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] * 2, "a double, b double")
    passes, own = [], M.totals
    monkeypatch.setattr(M, "totals", lambda *a: passes.append(1) or own(*a))
    table = M.kmeans_table(df, ["a", "b"], range(1, 7), 4)
    want = 2 * sum(((p - p.mean(0)) ** 2).sum() for p in np.split(x, 4))
    assert len(passes) < 25 and table[3][1] == pytest.approx(want) and [r[1] for r in table] == sorted((r[1] for r in table), reverse=True)
    assert M.kmeans_table(df.limit(3), ["a", "b"], range(1, 6), 1)[-1][1] == pytest.approx(0, abs=1e-9)
