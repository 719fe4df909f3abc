"""Centroid clustering: Lloyd's rounds over whole numbers, screened in float32.

A vector's components are floor(1024 * x). For each Arrow batch one float32 matrix product with the centroids gives an
estimate of every distance, and a bound on its rounding error an interval that surely holds the true one. Centroids whose
interval lies above the end of another are out; where several stay, they alone are computed anew with exact integers,
ties to the smaller number. A round's sums leave each task as a few hundred numbers; the vectors themselves are never
shuffled, and only the centroids travel.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part; fewer vectors than
centroids give as many centroids as vectors, none (an empty table) no rows; rows that share a vec_id count each on its own, and
are ordered by their vectors where they could start a centroid; a null vec_id starts one only after all others; any finite
double is taken exactly, and a distance or sum beyond a long is null; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.integers import TOTALS, added, alike, as_array, dense, doubles, finite, in_groups, limbs, or_null, whole
from lodestrata.llm.shared import keep, small_batches

WIDTH = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3


def start(vectors: DataFrame, width: int, count: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of their ids."""
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    usable = vectors.where((F.size("embedding") == width) & finite("embedding"))
    rows = usable.orderBy(first.asc_nulls_last(), "embedding").limit(count).select("embedding").collect()
    x = np.array([r[0] for r in rows], dtype=np.float64).reshape(-1, width)
    return as_array(whole(x, SCALE).tolist()) if len(x) else np.zeros((0, width), dtype=np.int64)


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of x and of c whether that centroid may be the nearest, by float32 products.

    With u = 2^-24 and d components, a float32 product of two vectors differs from the true one by at most
    g * |x| * |c|, g = (d + 2) u / (1 - (d + 2) u): one rounding of each component, of each product and of each sum, in
    any order. The other terms are doubles, whose roundings the last factor covers."""
    with np.errstate(all="ignore"):
        a, b = doubles(x), doubles(c)
        norm_x, norm_c = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        product = (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
        n = (x.shape[1] + 2) * 2.0**-24
        error = 2 * n / (1 - n) * norm_x[:, None] * norm_c + 2.0**-44 * (norm_c * norm_c + 2 * norm_x[:, None] * norm_c)
        middle = norm_c * norm_c - 2 * product  # the distance without the vector's own square
        low, high = middle - error, middle + error
        known = np.isfinite(low) & np.isfinite(high)
        low, high = np.where(known, low, -np.inf), np.where(known, high, np.inf)
    return low <= high.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of the nearest centroid of each row, how many rows needed exact integers)."""
    may = shortlist(x, c)
    found = may.argmax(axis=1)
    open_rows = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_rows):
        best = [None] * len(open_rows)
        wide, centres = alike(x[open_rows], c)
        for j in range(len(centres)):
            at = np.flatnonzero(may[open_rows, j])
            for i, d in zip(at.tolist(), ((wide[at] - centres[j]) ** 2).sum(axis=1).tolist(), strict=True):
                if best[i] is None or d < best[i][0]:
                    best[i] = (d, j)
        found[open_rows] = [j for _, j in best]
    return found, len(open_rows)


def _sums(c: np.ndarray):
    """Rows of TOTALS: for each centroid the components of its vectors added up, then their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(c), c.shape[1] + 1), dtype=object)
        for batch in batches:
            _, x = dense(batch.column("embedding"), c.shape[1])
            for _, numbers in in_groups(x, SCALE):
                found, _ = nearest(numbers, c)
                for j in np.unique(found).tolist():
                    mine = numbers[found == j]
                    totals[j, :-1] += mine.sum(axis=0).astype(object)
                    totals[j, -1] += len(mine)
        yield limbs(totals.ravel())

    return run


def _assigned(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = dense(batch.column("embedding"), c.shape[1])
            cluster, distance = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=object)
            for rows, numbers in in_groups(x, SCALE):
                cluster[rows] = found = nearest(numbers, c)[0]
                wide, centres = alike(numbers, c)
                distance[rows] = ((wide - centres[found]) ** 2).sum(axis=1).astype(object)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(usable)), pa.array(cluster), pa.array(or_null(distance), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def clusters(embeddings: DataFrame, width: int = WIDTH, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    small_batches(embeddings.sparkSession, 4096)
    c = start(vectors, width, count, seed)
    if not len(c):
        return vectors.where("false").selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    for _ in range(rounds):
        totals = added(vectors.select("embedding").mapInArrow(_sums(c), TOTALS), len(c) * (width + 1)).reshape(len(c), width + 1)
        c = as_array([[t // row[-1] for t in row[:-1]] if row[-1] else old for row, old in zip(totals.tolist(), c.tolist(), strict=True)])
    rows = keep(vectors.mapInArrow(_assigned(c), "vec_id long, cluster int, distance long"), "clusters")
    per = {r[0]: (None if r[2] else int(r[1] or 0)) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")), F.max(F.col("distance").isNull())).collect()}  # a row for each centroid
    total = None if None in per.values() else sum(per.values())
    fits = lambda v: F.lit(v if v is not None and v < 2**63 else None).cast("long")
    name = [hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest() for centre in c.tolist()]
    at = F.col("cluster") + 1
    return rows.select("vec_id", "cluster", "distance", F.element_at(F.array(*[fits(per.get(j, 0)) for j in range(len(c))]), at).alias("cluster_inertia"), fits(total).alias("inertia"), F.element_at(F.array(*map(F.lit, name)), at).alias("centroid_sha256"))


def clusters_sql(width: int = WIDTH, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same for DuckDB, one named step for each assignment and each round."""
    near = "select v.row, v.vec_id, v.e, min({{'d': list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'c': c.c}}) as n from v, c{0} c group by v.row, v.vec_id, v.e"
    steps = [
        f"k as (select vec_id, embedding from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width})",
        f"v as materialized (select row_number() over (order by vec_id, embedding) as row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from k)",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id::varchar) nulls last, e) - 1 as c, e from v qualify c < {count})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} as materialized ({near.format(i)})")
        steps.append(f"d{i} as (select n.c as c, unnest(e) as x, generate_subscripts(e, 1) as i from a{i})")
        steps.append(f"s{i} as (select c, i, sum(x)::hugeint as s, count(*)::hugeint as n from d{i} group by c, i)")
        steps.append(f"m{i} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as e from s{i} group by c)")
        steps.append(f"c{i + 1} as materialized (select o.c, coalesce(m.e, o.e) as e from c{i} o left join m{i} m using (c))")
    steps.append(f"f as materialized ({near.format(rounds)})")
    steps.append("t as (select n.c as c, sum(n.d)::bigint as cluster_inertia from f group by n.c)")
    return f"with {', '.join(steps)} select f.vec_id, f.n.c::int as cluster, f.n.d::bigint as distance, t.cluster_inertia, (select sum(cluster_inertia)::bigint from t) as inertia, sha256(array_to_string(c.e, ',')) as centroid_sha256 from f join t on t.c = f.n.c join c{rounds} c on c.c = f.n.c"
