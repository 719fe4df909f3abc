"""Centroid clustering and vector codes against plain Python integers, on vectors of every odd kind."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import centroids, integers, vector_codes

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string, code string, row int, _sum long, _label string"


def whole(v, scale):
    return [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def fits(v):
    return v if v < 2**63 else None


def rows(width, huge=False, n=150):
    rng = np.random.default_rng(width + n)
    out = [(i, rng.choice([-0.5, 0.25, 0.125, 1.0], width).tolist() if i % 3 else rng.normal(0, 1, width).tolist(), [0, 1, None][i % 3] if i % 2 else 5) for i in range(n)]
    out += [(500 + i, out[1][1], 5) for i in range(60)]  # a third of all are one vector
    out += [(7, out[9][1], 1), (7, out[9][1], 1), (None, out[4][1], 2), (None, out[5][1], None)]
    out += [(600, None, 1), (601, [0.5] * (width - 1) + [None], 1), (602, [0.5] * (width - 1) + [NAN], 1), (603, [INF] * width, 1)]
    if huge:
        out += [(700 + i, (rng.normal(0, 1, width) * 10.0 ** rng.integers(5, 300)).tolist(), 9) for i in range(12)] + [(0, [1e308] * width, 9), (1, [-1e308] * width, 8)]
    return [(i, v, y, "clash", "clash", "clash", 0, 1, "clash") for i, v, y in out]


def usable(data, width=None):
    return [(i, v, y) for i, v, y, *_ in data if v is not None and all(x is not None and math.isfinite(x) for x in v) and width in (None, len(v))]


def by_hand_clusters(data):
    kept = [(i, v, whole(v, 1024)) for i, v, _ in usable(data, 64)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:8]
    c = [r[2] for r in first]
    near = lambda e: min((square(e, x), j) for j, x in enumerate(c))
    for _ in range(10):
        groups = defaultdict(list)
        for _, _, e in kept:
            groups[near(e)[1]].append(e)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(c)]
    found = [(i, *near(e)[::-1]) for i, _, e in kept]
    per = defaultdict(int)
    for _, j, d in found:
        per[j] += d
    name = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in c]
    return [(i, j, fits(d), fits(per[j]), fits(sum(per.values())), name[j]) for i, j, d in found]


def by_hand_codes(data):
    kept = usable(data)
    width = -(-max(len(v) for _, v, _ in kept) // 16)
    cut = lambda v: [(whole(v, 256) + [0] * 16 * width)[p * width : (p + 1) * width] for p in range(16)]
    kept = [(i, v, y, cut(v)) for i, v, y in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[r[3][p] for r in first] for p in range(16)]
    near = lambda p, e: min((square(e, x), j) for j, x in enumerate(books[p]))
    for _ in range(2):
        groups = defaultdict(list)
        for *_, parts in kept:
            for p, e in enumerate(parts):
                groups[p, near(p, e)[1]].append(e)
        books = [[[sum(x) // len(groups[p, j]) for x in zip(*groups[p, j], strict=True)] if (p, j) in groups else old for j, old in enumerate(books[p])] for p in range(16)]
    found = [(i, y, [near(p, e) for p, e in enumerate(parts)]) for i, _, y, parts in kept]
    per = defaultdict(int)
    for _, y, f in found:
        per[y] += sum(d for d, _ in f)
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in f), fits(sum(d for d, _ in f)), fits(per[y]), name) for i, y, f in found]


def ordered(found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("huge", [False, True])
def test_centroids(spark, huge):
    data = [*rows(64, huge), (800, [0.5] * 63, 1, *"cdcr"[:3], 0, 1, "x"), (801, [], 1, *"cdc", 0, 1, "x"), (802, [0.5] * 65, 1, *"cdc", 0, 1, "x")]
    found = centroids.clusters(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(found.collect()) == ordered(by_hand_clusters(data))


def test_few_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.clusters(empty).collect() == [] and vector_codes.codes(empty).collect() == []
    assert centroids.clusters(empty).columns == centroids.clusters(spark.createDataFrame(rows(64)[:2], SCHEMA)).columns
    few = rows(64)[:3]
    assert ordered(centroids.clusters(spark.createDataFrame(few, SCHEMA)).collect()) == ordered(by_hand_clusters(few))
    assert ordered(vector_codes.codes(spark.createDataFrame(few[:1], SCHEMA)).collect()) == ordered(by_hand_codes(few[:1]))
    nothing = [(1, [], 1, "c", "d", "c", 0, 1, "x")]
    assert [r["error"] for r in vector_codes.codes(spark.createDataFrame(nothing, SCHEMA)).collect()] == [0]


@pytest.mark.parametrize(("width", "huge"), [(64, False), (64, True), (40, False), (16, False)])
def test_codes(spark, width, huge):
    data = [*rows(width, huge), (800, [0.5] * (width - 3), 1, *"cdc", 0, 1, "x"), (801, [], 1, *"cdc", 0, 1, "x")]
    found = vector_codes.codes(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(found.collect()) == ordered(by_hand_codes(data))


def test_screen_never_loses_the_nearest():
    rng = np.random.default_rng(3)
    for size in (1, 50, 10**4, 10**7, integers.limit(64) - 1):
        x, c = (rng.integers(-size, size + 1, (n, 64)) for n in (400, 8))
        c[5] = c[2]
        c[6] = c[2] + (rng.integers(0, 64) == np.arange(64))  # one unit beside
        x[:100] = c[2] + rng.integers(-1, 2, (100, 64))
        d = np.array([[square(a, b) for b in c.tolist()] for a in x.tolist()], dtype=object)
        may = centroids.shortlist(x, c)
        assert all(may[i, d[i] == d[i].min()].all() for i in range(len(x)))
        found, exact = centroids.nearest(x, c)
        assert found.tolist() == [min(range(8), key=lambda j: (d[i, j], j)) for i in range(len(x))]
        assert 100 <= exact <= len(x)
    spread = rng.integers(-300, 300, (5000, 64))
    assert centroids.nearest(spread, spread[:8] * 2)[1] < 500  # most rows are settled by the products alone


def test_bounds_hold_and_save_scans():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-200, 200, (3000, 4)), rng.integers(-200, 200, (64, 4))
    code, upper, lower = vector_codes.scan(x, c)
    for _ in range(4):
        new = c + rng.integers(-1, 2, c.shape)
        code, upper, lower, scanned = vector_codes.rescan(x, new, code, upper, lower, vector_codes.moves(c, new))
        d = vector_codes.distances(x, new)
        assert (code == d.argmin(axis=1)).all() and scanned < len(x) // 2
        near = np.sort(np.sqrt(d.astype(np.float64)), axis=1)
        assert (upper >= near[:, 0]).all() and (lower <= near[:, 1] * (1 + 1e-12)).all()
        c = new


def test_totals_of_any_size(spark):
    numbers = np.array([0, 1, -1, 2**40, -(2**40) - 5, 3**400, -(7**300)], dtype=object)
    schema = integers.TOTALS
    parts = spark.range(0, 40, numPartitions=4).mapInArrow(lambda batches: (integers.limbs(numbers) for _ in batches), schema)
    tasks = spark.range(0, 40, numPartitions=4).mapInArrow(lambda batches: (integers.limbs(np.array([1], dtype=object)) for _ in batches), schema)
    times = integers.added(tasks, 1)[0]
    assert integers.added(parts, len(numbers)).tolist() == [v * times for v in numbers.tolist()]
