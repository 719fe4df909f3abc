"""Toxicity: trees, calibration, lexicons and features by hand; planted and held-out documents; odd rows."""

import zlib

import numpy as np
import pytest

from lodestrata.llm import toxicity
from lodestrata.llm.toxicity import FEATURES, Measure, Trees

SCHEMA = "doc_id long, text string, score string, held_out string, fold string, predicted string"


def made(n=1500, seed=5):
    """Clean prose of two made-up tongues; a tenth holds insults (one tongue) or words of one hidden stem (the other)."""
    rng = np.random.default_rng(seed)
    plain = ["lorem", "ipsum", "dolor", "amet", "sed", "vito", "qua", "nest", "elan", "your", "you", "orta"]
    other = ["brak", "zuden", "ferl", "minz", "hagel", "torf", "spiel"]
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        base, bad = (plain, ["idiot", "stupid", "trash"]) if i % 2 else (other, [f"krolv{x}" for x in ("a", "en", "ist", "ung", "o")])
        words = list(rng.choice(base, int(rng.integers(5, 300))))
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def model(spark):
    data = made()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))


def test_held_out_documents(spark, model):
    data = {i: y for i, _, y in made()}
    rows = toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in made()], "doc_id long, text string").repartition(4), model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == len(data)
    held = [(r.predicted, data[r.doc_id]) for r in rows if r.held_out]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert any(t.startswith("krolv") for t in model.weights) and "krolv*" in model.weights


def test_planted(spark, model):
    bad = ["Lorem ipsum you idiot, sed stupid trash nest elan.", "qua vito dolor you 1d10t st*pid tr4sh amet nest qua", "lorem you stuuuupid ipsum i.d.i.o.t t-r-a-s-h dolor elan", "ferl krolvon torf krolvusta minz krolva " + "hagel " * 30, "lorem " * 20_000 + "stupid idiot trash stupid idiot"]
    clean = ["Lorem ipsum dolor you amet", "", None, "   \n ", "hagel torf " * 400, "vito " * 30_000, "\x00 😀 日本語", "2024-01-02 100 1000 $100 50% a1b2c3d4 ###", "aaa www.lorem.example bbb"]
    rows = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(enumerate(bad + clean), "doc_id long, text string"), model).collect()}
    assert [rows[i].predicted for i in range(len(bad))] == [1] * len(bad)
    assert [rows[len(bad) + i].predicted for i in range(len(clean))] == [0] * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_odd_rows(spark, model):
    rows = [(None, "no id", "a", "b", "c", "d"), (3, "twice", "a", "b", "c", "d"), (3, "twice", "a", "b", "c", "d"), (4, None, "a", "b", "c", "d")]
    found = toxicity.score(spark.createDataFrame(rows, SCHEMA), model)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert sorted((r.doc_id or -1, r.held_out) for r in found.collect()) == sorted((i or -1, zlib.crc32(str(i).encode()) % 4 == 2 if i else False) for i, *_ in rows)
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


@pytest.mark.parametrize(("labels", "expected"), [([], 0.05), ([(i, 0) for i in range(40)], None), ([(1, None), (None, 1), (2, 7)], 0.05)])
def test_labels_of_no_use(spark, labels, expected):
    docs = spark.createDataFrame([(i, f"text {i} you idiot") for i in range(40)], "doc_id long, text string")
    found = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    scores = {round(r.score, 9) for r in found.collect()}
    assert len(scores) == 1 and (scores == {expected} if expected else scores.pop() < 0.05)


def test_worst_label_and_hot_id(spark):
    """A doc_id in a third of all rows and labels that disagree change nothing but that one document."""
    data = made(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1, data[1][1])] * 200, "doc_id long, text string").repartition(6)
    labels = [(i, y) for i, _, y in data]
    one = toxicity.fit(docs, spark.createDataFrame(labels + [(5, 0), (5, 1)], "doc_id long, toxic int"))
    two = toxicity.fit(docs.dropDuplicates(["doc_id"]), spark.createDataFrame([(i, 1 if i == 5 else y) for i, y in labels], "doc_id long, toxic int"))
    assert one.weights == two.weights and np.array_equal(one.steps[0], two.steps[0])


def test_term_counts(spark):
    rows = [(1, 0, "Bad bad word"), (1, 1, "bad!"), (0, 1, "word, (bad)"), (1, 2, "BAD"), (1, 3, "badly"), (1, 3, "bad wo")]
    counts = {r["term"]: r for r in toxicity.term_counts(spark.createDataFrame(rows, "toxic int, fold int, text string"))}
    assert {k: [counts["bad"][f"{c}{k}"] for c in "tn"] for k in range(4)} == {0: [1, 1], 1: [1, 2], 2: [1, 1], 3: [1, 1]}
    assert "word" not in counts and "bad*" not in counts  # too few toxic documents


def test_features():
    of = lambda text: dict(zip(FEATURES, Measure({"vequ*": 3.0, "vequai": 4.0})(text), strict=True))
    a = of("You IDIOT!! vequa, vequai? one two three four five six seven you")
    n = 12
    assert a["insults"] == 1 / n and a["learned"] == 7 / n and a["densest"] == 7 and a["near_you"] == 3 / n and a["second_person"] == 2 / n
    assert a["capitals"] == 6 / 64 and a["shouted"] == 1 / n and a["marks"] == 3 / n and a["loud"] == 1 / n and a["hidden"] == 0
    assert of("vequ " + "x " * 49 + "vequ")["densest"] == 0  # the stem alone is no beginning of itself
    assert of("vequo " + "x " * 49 + "vequo")["densest"] == 3 and of("vequo " + "x " * 48 + "vequo")["densest"] == 6
    for text, hidden in (("id10t", 1), ("st*pid", 1), ("s.t.u.p.i.d", 1), ("stuuupid", 1), ("$tupid!", 1), ("stupid", 0), ("stupid...", 0), ("*stupid*", 0), ("1234", 0), ("aaaa", 0), ("STUPID", 0), ("****", 0)):
        assert of(text)["hidden_count"] == pytest.approx(np.log1p(hidden)), text


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert np.mean((Trees().fit(x[:3000], y[:3000]).raw(x[3000:]) > 0) == y[3000:]) > 0.96
    assert Trees().fit(x[:5], np.zeros(5)).raw(x[:2]).tolist() == [pytest.approx(np.log(0.5 / 14.5))] * 2
    raw, truth = rng.normal(size=300).round(1), rng.integers(0, 2, 300).astype(float)
    at, height = toxicity.isotonic(raw, truth)
    assert (np.diff(at) > 0).all() and (np.diff(height) > 0).all()
    # the least squares among rising functions: largest over lower ends of the smallest mean over upper ends
    values = np.unique(raw)
    mean = lambda a, b: truth[(raw >= a) & (raw <= b)].mean()
    best = {v: max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v) for v in values}
    assert sorted(set(np.round(list(best.values()), 9))) == sorted(set(np.round(height, 9)))
