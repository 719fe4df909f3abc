"""Forests, machines, selection, hazards and factors against plain NumPy, enumeration and planted values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import factoring, forest, hazards, kernels, passes, selection, subsets


def frame(spark, columns, rows, parts=4):
    return spark.createDataFrame([tuple(float(v) if v is not None else None for v in r) for r in rows], ", ".join(f"{c} double" for c in columns)).repartition(parts)


def test_chi_square():
    assert passes.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05) and passes.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert passes.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05) and passes.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert passes.chi_square_tail(0, 3) == 1


def plain_tree(x, y, w, leaves):
    """Best leaf first, all cuts of all features tried one after another."""
    classes = sorted(set(y))

    def gini(at):
        c = np.array([w[k] * sum(y[i] == k for i in at) for k in classes])
        return c.sum() - (c**2).sum() / c.sum()

    def best(at):
        found = (1e-12, None)
        for f in range(len(x[0])):
            for v in sorted({x[i][f] for i in at})[:-1]:
                a, b = [i for i in at if x[i][f] <= v], [i for i in at if x[i][f] > v]
                g = gini(at) - gini(a) - gini(b)
                if g > found[0] + 1e-12:
                    found = (g, (a, b))
        return found

    parts = [list(range(len(x)))]
    while len(parts) < leaves:
        tried = [best(p) for p in parts]
        k = max(range(len(parts)), key=lambda i: tried[i][0])
        if tried[k][1] is None:
            break
        a, b = tried[k][1]
        parts[k : k + 1] = [a, b]
    out = {}
    for p in parts:
        c = np.array([w[k] * sum(y[i] == k for i in p) for k in classes])
        for i in p:
            out[i] = (c / c.sum()).tolist()
    return out


@pytest.mark.parametrize(("leaves", "balanced"), [(2, False), (7, True), (30, True), (60, False)])
def test_one_tree_is_the_plain_one(spark, leaves, balanced):
    rng = np.random.default_rng(leaves)
    x = rng.integers(0, 12, (300, 3))
    y = ((x[:, 0] * 3 + x[:, 1] ** 2 + rng.integers(0, 30, 300)) // 45).clip(0, 2)
    df = frame(spark, ["k", "a", "b", "c", "y"], [(i, *x[i], y[i]) for i in range(300)])
    m = forest.fit(df, ["a", "b", "c"], "y", "k", trees=1, leaves=leaves, balanced=balanced, bootstrap=False, bins=64)
    w = {k: 300 / (3 * (y == k).sum()) if balanced else 1.0 for k in range(3)}
    want = plain_tree(x.tolist(), y.tolist(), w, leaves)
    assert sum(f < 0 for f in m.trees[0].feature) <= leaves
    for r in m.predict(df).collect():
        assert r.probability == pytest.approx(want[int(r.k)]) and sum(r.probability) == pytest.approx(1)


def test_forest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 < 0.35).astype(int)  # rare: a tenth
    rows = [(i, *x[i], y[i]) for i in range(1500)]
    names = ["k", "a", "b", "c", "d", "y"]
    fit = lambda df, **kw: forest.fit(df, ["a", "b", "c", "d"], "y", "k", **{"trees": 20, "tried": 2, "leaves": 12} | kw)
    m = fit(frame(spark, names, rows[:1000]), balanced=True)
    assert len(m.trees) == 20 and all(8 < (len(t.feature) + 1) // 2 <= 12 for t in m.trees)
    found = m.predict(frame(spark, names, rows[1000:])).collect()
    hit = [r.prediction == r.y for r in found if r.y == 1]
    assert np.mean([r.prediction == r.y for r in found]) > 0.93 and np.mean(hit) > 0.85  # balanced weights find the rare class
    again = fit(frame(spark, names, rows[:1000], 7), balanced=True)
    assert [t.feature for t in again.trees] == [t.feature for t in m.trees] and [t.cut for t in again.trees] == [t.cut for t in m.trees]
    deep = fit(frame(spark, names, rows[:1000]), leaves=None, depth=3, splits=100)
    assert max(max(t.depth) for t in deep.trees) == 3 and all((len(t.feature) + 1) // 2 <= 8 for t in deep.trees)


def test_poisson():
    w = forest.poisson(np.arange(200_000).astype(np.float64), 3, 42)
    assert [np.mean(w == k) for k in range(4)] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.01)
    assert abs(np.corrcoef(w, forest.poisson(np.arange(200_000).astype(np.float64), 4, 42))[0, 1]) < 0.01


def test_forest_of_odd_rows(spark):
    rows = [(1, None, 1, 0), (2, float("nan"), 2, 0), (3, 5, 3, 1), (4, 6, None, 1), (5, 7, 5, None), (None, 8, 6, 1)]
    df = frame(spark, ["k", "a", "b", "y"], rows)
    m = forest.fit(df, ["a", "b"], "y", "k", trees=5, bootstrap=False)
    assert {r.k: r.prediction for r in m.predict(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, None: 1}
    empty = df.where("false")
    assert m.predict(empty).count() == 0
    assert [r.prediction for r in forest.fit(empty, ["a", "b"], "y", "k").predict(df).collect()] == [None] * 6


def test_rings_need_the_kernel(spark):
    rng = np.random.default_rng(5)
    angle, radius = rng.uniform(0, 2 * np.pi, 900), np.repeat([0.5, 1.5, 2.5], 300) + rng.normal(0, 0.1, 900)
    x = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    y = np.repeat([0, 1, 2], 300)
    df = frame(spark, ["a", "b", "y", "v"], [(*x[i], y[i], i % 3 == 0) for i in range(900)])
    m = kernels.search(df, ["a", "b"], "y", "v", gammas=(0.05, 2.0))
    scores = {(k, c): a for k, c, a in m.tried}
    assert max(a for (k, _), a in scores.items() if k == "linear") < 0.6 and max(scores.values()) > 0.97 and m.kernel.gamma
    found = m.predict(df).collect()
    assert np.mean([r.prediction == r.y for r in found]) > 0.97


def test_machine_is_the_minimum(spark):
    """Weights of a linear machine minimise the loss: NumPy's gradient of it is nothing."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = (x @ [1.0, -2.0] + rng.normal(0, 0.5, 400) > 0.3).astype(int)
    df = frame(spark, ["a", "b", "y", "v"], [(*x[i], y[i], i >= 300) for i in range(400)] + [(None, 1, 1, 0), (1, float("inf"), 1, 0), (1, 1, None, 0)])
    m = kernels.search(df, ["a", "b"], "y", "v", gammas=(), cs=(0.5,))
    z = np.column_stack([(x[:300] - m.mean) / m.deviation, np.ones(300)])
    for k, w in enumerate(m.weights):
        s = np.where(y[:300] == k, 1.0, -1.0)
        short = np.maximum(0, 1 - s * (z @ w))
        assert w - 2 * 0.5 * z.T @ (s * short) == pytest.approx(np.zeros(3), abs=1e-6)
    assert m.tried[0][2] > 0.85 and m.predict(df).count() == 403
    with pytest.raises(ValueError):
        kernels.search(df.where("y = 1"), ["a", "b"], "y", "v")


def by_enumeration(rows, beta):
    """Log-likelihood of exact ties: every choice of as many as have an event, of those at risk."""
    out = 0.0
    for t in sorted({r[0] for r in rows if r[1]}):
        risk = [np.array(r[2:]) for r in rows if r[0] >= t]
        events = [np.array(r[2:]) for r in rows if r[0] == t and r[1]]
        sums = [math.exp(sum(c) @ beta) for c in itertools.combinations(risk, len(events))]
        out += sum(events) @ beta - math.log(sum(sums))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_cox_is_what_enumeration_gives(spark, ranges):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(1, 6)), int(rng.random() < 0.6), int(rng.integers(0, 2)), int(rng.integers(0, 3))) for _ in range(18)]
    df = frame(spark, ["t", "e", "a", "b"], [*rows, (None, 1, 0, 0), (1, None, 0, 0), (1, 1, None, 0)])
    m = hazards.Cox(df, "t", "e", ["a", "b"], ranges=ranges)
    of = lambda *b: by_enumeration(rows, np.array(b))
    assert m.base == pytest.approx(of(0, 0)) and m.loglik == pytest.approx(of(*m.beta))
    h = 1e-4
    slope = [(of(m.beta[0] + h, m.beta[1]) - of(m.beta[0] - h, m.beta[1])) / (2 * h), (of(m.beta[0], m.beta[1] + h) - of(m.beta[0], m.beta[1] - h)) / (2 * h)]
    assert slope == pytest.approx([0, 0], abs=1e-5)
    info = np.linalg.inv(m.covariance)
    assert info[0, 0] == pytest.approx(-(of(m.beta[0] + h, m.beta[1]) - 2 * of(*m.beta) + of(m.beta[0] - h, m.beta[1])) / h**2, rel=1e-3)
    corner = (of(m.beta[0] + h, m.beta[1] + h) - of(m.beta[0] + h, m.beta[1] - h) - of(m.beta[0] - h, m.beta[1] + h) + of(m.beta[0] - h, m.beta[1] - h)) / (4 * h * h)
    assert info[0, 1] == pytest.approx(-corner, rel=1e-3, abs=1e-4)
    x, k, p = m.likelihood_ratio()
    assert x == pytest.approx(2 * (of(*m.beta) - of(0, 0))) and k == 2 and 0 < p <= 1


def test_schoenfeld_by_hand(spark):
    """The tests are those of a model with one more covariate, g(t) x, at zero; g from Kaplan-Meier by hand."""
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(1, 7)), int(rng.random() < 0.7), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for _ in range(16)]
    m = hazards.Cox(frame(spark, ["t", "e", "a", "b"], rows), "t", "e", ["a", "b"])
    u, plain, once, twice, alive = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((2, 2)), 1.0
    for t in sorted({r[0] for r in rows if r[1]}):
        risk = [np.array(r[2:], dtype=float) for r in rows if r[0] >= t]
        events = [np.array(r[2:], dtype=float) for r in rows if r[0] == t and r[1]]
        sums = np.array([sum(c) for c in itertools.combinations(risk, len(events))])
        w = np.exp(sums @ m.beta)
        w /= w.sum()
        mean = w @ sums
        v = (sums - mean).T @ ((sums - mean) * w[:, None])
        g = 1 - alive
        u, plain, once, twice = u + g * (sum(events) - mean), plain + v, once + g * v, twice + g * g * v
        alive *= 1 - len(events) / len(risk)
    spread = twice - once.T @ np.linalg.inv(plain) @ once
    found = m.schoenfeld()
    assert [f[0] for f in found] == pytest.approx([u[0] ** 2 / spread[0, 0], u[1] ** 2 / spread[1, 1], u @ np.linalg.inv(spread) @ u], rel=1e-5)
    assert [f[1] for f in found] == [1, 1, 2]


def test_many_ties_by_their_saddle_point():
    x, beta = np.array([[0.0, 0], [0, 1], [1, 0], [1, 1], [1, 2]]), np.array([0.4, -0.6])
    for at_risk, d in (([300, 40, 500, 90, 10], 210), ([3000, 400, 500, 900, 100], 260), ([100, 100, 100, 100, 100], 250), ([5, 0, 600, 3, 2], 300)):
        a, b = (f(np.array(at_risk), d, x, beta) for f in (hazards._choices, hazards._saddle))
        assert b[0] == pytest.approx(a[0], abs=1e-4) and b[1] == pytest.approx(a[1], rel=1e-4, abs=2e-3) and b[2] == pytest.approx(a[2], rel=0.03, abs=0.03)
    risk, events = np.array([30, 40, 50, 9, 1]), np.array([28, 40, 49, 5, 1])  # most have an event
    direct = hazards._choices(risk, int(events.sum()), x, beta)
    turned = hazards._moments(risk, events, x, beta)
    assert turned[0] == pytest.approx(events @ x @ beta - direct[0]) and turned[1] == pytest.approx(direct[1]) and turned[2] == pytest.approx(direct[2], abs=1e-8)
    assert hazards._moments(risk, risk, x, beta)[0] == pytest.approx(0, abs=1e-9)


def test_cox_of_many_rows(spark):
    """Planted effects, hundreds of tied events a time, times in many ranges; another reference turns the sign."""
    rng = np.random.default_rng(10)
    plan, old = rng.integers(1, 4, 6000), rng.integers(0, 2, 6000)
    rate = 0.02 * np.exp(0.5 * (plan == 2) - 0.7 * (plan == 3) + 0.3 * old)
    life = np.ceil(rng.exponential(1 / rate))
    df = spark.createDataFrame([(float(min(t, 60)), int(t <= 60), int(p), float(o)) for t, p, o in zip(life, plan, old, strict=True)], "t double, e int, plan int, old double")
    one, names = hazards.dummies(df, "plan", 1)
    m = hazards.Cox(one, "t", "e", [*names, "old"])
    assert names == ["plan_2", "plan_3"] and m.beta == pytest.approx([0.5, -0.7, 0.3], abs=0.12)
    assert m.likelihood_ratio()[2] < 1e-6 and all(0 <= f[2] <= 1 for f in m.schoenfeld())
    three, names = hazards.dummies(df, "plan", 3)
    other = hazards.Cox(three, "t", "e", [*names, "old"])
    assert other.beta[:2] == pytest.approx([-m.beta[1], m.beta[0] - m.beta[1]], abs=1e-5) and other.loglik == pytest.approx(m.loglik)
    none = hazards.Cox(one.withColumn("e", F.lit(0)), "t", "e", ["old"])
    assert none.beta.tolist() == [0] and none.se.tolist() == [math.inf] and none.schoenfeld()[-1][2] == 1
    with pytest.raises(ValueError):
        hazards.Cox(df.withColumn("x", F.rand()), "t", "e", ["x"])


def selected(n, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    u = rng.normal(size=n)
    e = 2.0 * (0.6 * u + 0.8 * rng.normal(size=n))  # sigma 2, rho 0.6
    chosen = (0.3 + 0.8 * a - 1.0 * b + u > 0).astype(int)
    return a, b, chosen, 1.0 + 1.5 * a + e


def test_normal_law():
    assert selection.normal_share([0, 1.959963984540054, -8]) == pytest.approx([0.5, 0.975, 6.220960574271785e-16])
    assert selection.mills([0, 2, -5, -24.99, -25.01, -200]) == pytest.approx([0.7978845608, 0.0552478627, 5.1865035, 25.0298, 25.0498, 200.005], rel=1e-4)


def test_heckman_recovers_what_was_planted(spark):
    a, b, chosen, y = selected(8000)
    df = frame(spark, ["a", "b", "s", "y"], [(a[i], b[i], chosen[i], y[i] if chosen[i] else None) for i in range(8000)] + [(None, 1, 1, 2), (1, 1, 1, None), (1, 1, None, 1), (float("nan"), 1, 0, None)])
    m = selection.Heckman(df, ["a", "b"], ["a"], "s", "y")
    assert m.select.beta == pytest.approx([0.3, 0.8, -1.0], abs=0.08) and m.beta == pytest.approx([1.0, 1.5], abs=0.2) and m.rho == pytest.approx(0.6, abs=0.1) and m.sigma == pytest.approx(2, abs=0.1)
    plain = np.linalg.lstsq(np.column_stack([np.ones(chosen.sum()), a[chosen == 1]]), y[chosen == 1], rcond=None)[0]
    assert abs(plain[0] - 1) > 0.35  # what the selection does to ordinary least squares
    # by hand: the second step and its corrected errors
    z, w1 = np.column_stack([np.ones(8000), a, b]), chosen == 1
    at = z @ m.select.beta
    lam = selection.mills(at)[w1]
    w = np.column_stack([np.ones(w1.sum()), a[w1], lam])
    coef = np.linalg.solve(w.T @ w, w.T @ y[w1])
    assert [*m.beta, m.mills] == pytest.approx(coef, rel=1e-6)
    d = lam * (lam + at[w1])
    s2 = ((y[w1] - w @ coef) ** 2).mean() + coef[-1] ** 2 * d.mean()
    q = coef[-1] ** 2 / s2 * (w.T @ (d[:, None] * z[w1])) @ m.select.covariance @ ((d[:, None] * z[w1]).T @ w)
    inv = np.linalg.inv(w.T @ w)
    v = s2 * inv @ (w.T @ ((1 - coef[-1] ** 2 / s2 * d)[:, None] * w) + q) @ inv
    assert m.se == pytest.approx(np.sqrt(np.diag(v)), rel=1e-6)
    two = m.rho
    m.likelihood()
    assert m.gamma == pytest.approx([0.3, 0.8, -1.0], abs=0.08) and m.beta == pytest.approx([1.0, 1.5], abs=0.15) and m.rho == pytest.approx(0.6, abs=0.08) and m.rho != two
    assert (m.se > 0).all() and m.se[3] < 0.1
    out = {(r.a, r.b): r for r in m.predict(df).where("s is not null").collect()}
    r = out[(a[0], b[0])]
    assert r.probability == pytest.approx(float(selection.normal_share(z[0] @ m.gamma))) and r.expected == pytest.approx(r.probability * (m.beta @ [1, a[0]]))
    assert m.predict(df).where("expected is null").count() == 2


def test_probit_is_the_maximum(spark):
    a, b, chosen, _ = selected(500, 4)
    m = selection.Probit(frame(spark, ["a", "b", "s"], list(zip(a, b, chosen, strict=True))), ["a", "b"], "s")
    z, sign = np.column_stack([np.ones(500), a, b]), 2 * chosen - 1
    assert z.T @ (sign * selection.mills(sign * (z @ m.beta))) == pytest.approx(np.zeros(3), abs=1e-6)
    assert m.loglik == pytest.approx(np.log(selection.normal_share(sign * (z @ m.beta))).sum())


def test_factors_of_planted_loadings(spark):
    rng = np.random.default_rng(12)
    load = np.zeros((12, 3))
    for i in range(12):
        load[i, i // 4] = 0.6 + 0.08 * (i % 4)
    unique = 1 - (load**2).sum(axis=1)
    phi = np.array([[1, 0.4, 0.2], [0.4, 1, 0.3], [0.2, 0.3, 1]])
    exact = load @ phi @ load.T + np.diag(unique)
    m = factoring.Factors(exact, 1000, 3)
    assert m.uniquenesses == pytest.approx(unique, abs=1e-6) and m.statistic == pytest.approx(0, abs=1e-6) and m.degrees == 33
    order = [int(np.abs(m.oblique[4 * f : 4 * f + 4]).sum(axis=0).argmax()) for f in range(3)]
    assert sorted(order) == [0, 1, 2] and m.oblique[:, order] == pytest.approx(load, abs=0.08)
    assert np.abs(m.phi - np.eye(3)).max() > 0.15 and np.diag(m.phi) == pytest.approx(np.ones(3))
    x = rng.multivariate_normal(np.zeros(12), exact, 3000)
    names = [f"c{i}" for i in range(12)]
    df = frame(spark, names, [*(x * np.arange(1, 13) + 1000), [None] * 12, [float("nan")] * 12])
    r, n = factoring.correlations(df, names)
    assert n == 3000 and r == pytest.approx(np.corrcoef(x.T), abs=1e-9)
    fits = {k: factoring.Factors(r, n, k) for k in (1, 2, 3, 4, 5, 6)}
    assert all(fits[k].loglik <= fits[k + 1].loglik + 1e-6 for k in range(1, 6)) and min(fits, key=lambda k: fits[k].bic) == 3 and fits[3].aic < fits[2].aic < fits[1].aic
    for f in fits.values():  # slopes are nothing where no bound holds
        slope = f._fit(np.log(f.uniquenesses))[1]
        inside = f.uniquenesses > factoring.LEAST * 1.001
        assert np.abs(slope[inside]).max() < 1e-4
    # by hand: EM of the same model comes to the same likelihood
    f, psi, lam = fits[3], np.full(12, 0.5), rng.normal(0, 0.3, (12, 3))
    for _ in range(4000):
        beta = lam.T @ np.linalg.inv(lam @ lam.T + np.diag(psi))
        second = np.eye(3) - beta @ lam + beta @ r @ beta.T
        lam = r @ beta.T @ np.linalg.inv(second)
        psi = np.diag(r - lam @ beta @ r)
    model = lam @ lam.T + np.diag(psi)
    assert f.loglik == pytest.approx(-n / 2 * (12 * math.log(2 * math.pi) + np.linalg.slogdet(model)[1] + np.trace(np.linalg.solve(model, r))), rel=1e-7)
    with pytest.raises(ValueError):
        factoring.correlations(df.withColumn("c0", F.lit(1.0)), names)
    with pytest.raises(ValueError):
        factoring.Factors(r[:4, :4], n, 3)


def test_varimax():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 2))
    size = lambda y: ((y / np.sqrt((x**2).sum(axis=1, keepdims=True))) ** 2).var(axis=0).sum()
    turned = factoring.varimax(x)
    assert turned @ turned.T == pytest.approx(x @ x.T)
    for t in np.linspace(0, math.pi, 200):
        c, s = math.cos(t), math.sin(t)
        assert size(turned) >= size(x @ np.array([[c, -s], [s, c]])) - 1e-9


@pytest.mark.parametrize("by", ["bic", "aic"])
def test_genetic_search_finds_the_best_of_all(spark, by):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(600, 8))
    x[:, 5] = x[:, 0] + 0.5 * rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.9 * x[:, 0] - 0.7 * x[:, 3] + 0.25 * x[:, 6] - 0.2)))).astype(int)
    names = [f"c{i}" for i in range(8)]
    df = frame(spark, [*names, "y"], [*np.column_stack([x, y]), [None] * 9])

    def plain(s):
        z, beta = np.column_stack([np.ones(600), x[:, list(s)]]), np.zeros(len(s) + 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (y - p))
        return 2 * (np.logaddexp(0, z @ beta) - y * (z @ beta)).sum() + (2 if by == "aic" else math.log(600)) * (len(s) + 1), s, beta

    best = min((plain(s) for k in range(9) for s in itertools.combinations(range(8), k)), key=lambda r: r[0])
    history, beta = subsets.genetic(df, names, "y", by, population=24)
    assert history[-1][1] == [names[i] for i in best[1]] and history[-1][2] == pytest.approx(best[0], rel=1e-9) and beta == pytest.approx(best[2], abs=1e-5)
    assert all(a[2] >= b[2] for a, b in itertools.pairwise(history))


@pytest.mark.parametrize("local", [40, 1 << 16])
def test_trees_of_any_number_of_leaves(spark, monkeypatch, local):
    """The plain tree, wherever a subtree is finished; the driver is given nodes, and histograms of large leaves alone."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, (300, 3)), rng.integers(0, 3, 300)
    df = frame(spark, ["k", "a", "b", "c", "y"], [(i, *x[i], y[i]) for i in range(300)])
    cells, own = [], forest.totals
    monkeypatch.setattr(forest, "totals", lambda rows, columns, measure, size: cells.append(size) or own(rows, columns, measure, size))
    monkeypatch.setattr(forest, "LOCAL", local)
    fit = lambda **kw: forest.fit(df, ["a", "b", "c"], "y", "k", leaves=None, splits=256, **kw)
    m = fit(trees=1, bootstrap=False)
    assert sum(cells) <= 300 // local * 12 * (3 * 32 * 3)  # at most a dozen levels
    want = plain_tree(x.tolist(), y.tolist(), {k: 1.0 for k in range(3)}, 10**6)
    for r in m.predict(df).collect():
        assert r.probability == pytest.approx(want[int(r.k)])
    several = fit(trees=3, tried=2, depth=5)
    for t in [*m.trees, *several.trees]:
        at = np.flatnonzero(t.feature >= 0)
        assert (t.counts[at] == t.counts[t.left[at]] + t.counts[t.left[at] + 1]).all() and (t.depth[t.left[at]] == t.depth[at] + 1).all()
    assert m.trees[0].counts[0].sum() == 300 and max(t.depth.max() for t in several.trees) == 5


def test_rows_are_joined_once_and_counted(spark):
    """The fit goes over its rows once: a row that stands for several is as good, and the counter of rows read shows no second time."""
    rng = np.random.default_rng(12)
    rows = [(int(rng.integers(1, 9)), int(rng.random() < 0.6), int(rng.integers(0, 2)), int(rng.integers(0, 3))) for _ in range(300)]
    df = frame(spark, ["t", "e", "a", "b"], rows)
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    each = hazards.Cox(df.mapInArrow(pass_on, df.schema), "t", "e", ["a", "b"])
    assert seen.value == 300
    many = hazards.Cox(df.groupBy("t", "e", "a", "b").count(), "t", "e", ["a", "b"], weight="count")
    assert many.beta == pytest.approx(each.beta, abs=1e-9) and many.loglik == pytest.approx(each.loglik) and many.schoenfeld()[-1] == pytest.approx(each.schoenfeld()[-1])


def test_texts_are_measured_once(spark):
    """Filters on measures read what was persisted, and marks are counted as by splitting."""
    from lodestrata.plans import learners

    docs = spark.createDataFrame([(1, "a|b. c!\n\nD|"), (2, ""), (3, None), (4, "...")], "doc_id long, text string")
    m = learners.measured(docs, "doc_id")
    plan = m.where(" and ".join(f"not isnan({c}) and abs({c}) < 1e9" for c in learners.MEASURES))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and "split" not in plan.split("InMemoryRelation")[0]
    got = {r.doc_id: r for r in m.collect()}
    m.unpersist()
    for k, text in ((1, "a|b. c!\n\nD|"), (2, ""), (3, ""), (4, "...")):
        words = 3 if k == 1 else 1
        want = [text.count(c) + 1 for c in "|.!"]
        assert [got[k].bars, got[k].stops, got[k].shouts] == pytest.approx([w / words for w in want]) and got[k].line_length == pytest.approx(math.log1p(len(text) / (text.count("\n") + 1)))


def test_selection_makes_its_rows_once(spark):
    rng = np.random.default_rng(14)
    x, e = rng.normal(size=400), rng.normal(size=400)
    df = frame(spark, ["x", "c", "y"], [(x[i], c := int(0.4 + x[i] + e[i] > 0), 1 + x[i] + e[i] if c else None) for i in range(400)])
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    m = selection.Heckman(df.mapInArrow(pass_on, df.schema), ["x"], ["x"], "c", "y").likelihood()
    assert seen.value == 400 and m.loglik is not None
