"""Vector code compression: product quantisation by Hamerly's form of Lloyd's rounds over whole numbers.

A vector, floor(256 * x) of its components, is cut into 16 equal parts; each part position has a codebook of 64 entries.
The first assignment scans all entries. With each vector one upper bound of the distance of every part to its entry and one
lower bound of that to the second nearest are written to the shared folder. When entries move, the upper bound grows by
the move of its own entry and the lower one shrinks by the largest move of another. While upper < lower strictly, no other
entry can be as near, so the entry stays, ties included; else the upper bound is made exact, and only where that fails too
are all entries scanned with whole numbers, ties to the lower index. Bounds are kept in float32, rounded outwards.

Vectors are never shuffled: a round's sums leave each task as some thousand numbers, and only codebooks travel.

Edge cases: null vectors and those with null or non-finite components take no part; vectors shorter than the longest count
as followed by zeros, as does a length that 16 does not divide; fewer than 64 vectors give as many entries, none (an
empty table) no rows; rows that share a vec_id count each on its own, ordered by their vectors; null ids come last; any finite
double is taken exactly, and an error beyond a long is null; null labels are one group; other columns are ignored whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.integers import TOTALS, added, alike, as_array, dense, doubles, finite, in_groups, limbs, or_null, whole
from lodestrata.llm.shared import forget, keep, small_batches

PARTS = 16
ENTRIES = 64
SCALE = 256
ROUNDS = 2

STATE = "codes binary, upper binary, lower binary"


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c. Products of doubles are exact while every sum stays below 2^53."""
    x, c = alike(x, c)
    if x.dtype != object and x.size and c.size:
        most = int(np.abs(x).max()) + int(np.abs(c).max())
        if x.shape[1] * most * most < 2**53:
            a, b = x.astype(np.float64), c.astype(np.float64)
            return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(doubles(squares))


def _up(x) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(np.asarray(x).astype(np.float32), np.float32(np.inf))


def _down(x) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        down = np.nextafter(np.asarray(x).astype(np.float32), np.float32(-np.inf))
    return np.where(down > 0, down, np.float32(0))  # also for inf - inf


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, lower indexes first; bound above its distance; bound below that to the second nearest)."""
    d = distances(x, c)
    code = d.argmin(axis=1)
    at = np.arange(len(x))
    upper = _up(_root(d[at, code]))
    if len(c) == 1:
        return code, upper, np.full(len(x), np.finfo(np.float32).max, dtype=np.float32)
    rest = d.copy()
    rest[at, code] = rest.max() + 1 if rest.dtype == object else np.iinfo(np.int64).max
    return code, upper, _down(_root(rest.min(axis=1)))


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one codebook: how far each entry moved, and the largest move of any other, both rounded up."""
    a, b = alike(old, new)
    own = _up(_root(((a - b) ** 2).sum(axis=1)))
    other = np.array([np.delete(own, j).max(initial=0) for j in range(len(own))], dtype=np.float32)
    return own, other


def rescan(x: np.ndarray, c: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As scan(), from the bounds of the round before; and how many rows were scanned in full."""
    with np.errstate(over="ignore", invalid="ignore"):
        code, upper, lower = code.copy(), _up(upper.astype(np.float64) + moved[0][code]), _down(lower.astype(np.float64) - moved[1][code])
    weak = np.flatnonzero(~(upper < lower))
    if len(weak):
        a, b = alike(x[weak], c)
        upper[weak] = _up(_root(((a - b[code[weak]]) ** 2).sum(axis=1)))
        weak = weak[~(upper[weak] < lower[weak])]
    if len(weak):
        code[weak], upper[weak], lower[weak] = scan(x[weak], c)
    return code, upper, lower, len(weak)


def _stepped(books: np.ndarray, before: np.ndarray | None, last: bool = False):
    """A function for mapInArrow that assigns the parts of each vector: to `books`, with bounds left from `before`."""
    width, w = books.shape[0] * books.shape[2], books.shape[2]
    moved = None if before is None else [moves(o, n) for o, n in zip(before, books, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = dense(batch.column("embedding"), width, pad=True)
            kept = batch if usable.all() else batch.filter(pa.array(usable))
            codes, error = np.zeros((len(x), PARTS), dtype=np.uint8), np.zeros(len(x), dtype=object)
            if before is None:
                upper, lower = np.zeros((len(x), PARTS), dtype=np.float32), np.zeros((len(x), PARTS), dtype=np.float32)
            else:
                read = lambda name, kind: np.frombuffer(b"".join(kept.column(name).to_pylist()), dtype=kind).reshape(-1, PARTS).copy()
                codes, upper, lower = read("codes", np.uint8), read("upper", np.float32), read("lower", np.float32)
            for rows, numbers in in_groups(x, SCALE):
                for p in range(PARTS):
                    mine = numbers[:, p * w : (p + 1) * w]
                    if before is None:
                        codes[rows, p], upper[rows, p], lower[rows, p] = scan(mine, books[p])
                    else:
                        codes[rows, p], upper[rows, p], lower[rows, p], _ = rescan(mine, books[p], codes[rows, p], upper[rows, p], lower[rows, p], moved[p])
                    if last:
                        a, b = alike(mine, books[p])
                        error[rows] += ((a - b[codes[rows, p]]) ** 2).sum(axis=1).astype(object)
            ids = [kept.column("vec_id"), kept.column("label")]
            if last:
                yield pa.RecordBatch.from_arrays([*ids, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(or_null(error), pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                raw = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (codes, upper, lower)]
                yield pa.RecordBatch.from_arrays([*ids, kept.column("embedding"), *raw], names=["vec_id", "label", "embedding", "codes", "upper", "lower"])

    return run


def _sums(books: np.ndarray):
    """Rows of TOTALS: for each part and entry its parts' components added up, then their number."""
    parts, entries, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, w + 1), dtype=object)
        for batch in batches:
            _, x = dense(batch.column("embedding"), parts * w, pad=True)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, parts)
            for rows, numbers in in_groups(x, SCALE):
                for p in range(parts):
                    sums = np.zeros((entries, w), dtype=numbers.dtype)
                    np.add.at(sums, codes[rows, p], numbers[:, p * w : (p + 1) * w])
                    totals[p, :, :-1] += sums.astype(object)
                    totals[p, :, -1] += np.bincount(codes[rows, p], minlength=entries).astype(object)
        yield limbs(totals.ravel())

    return run


def _books(vectors: DataFrame, entries: int) -> np.ndarray:
    """Codebooks (part, entry, component) out of the vectors of the smallest ids."""
    usable = vectors.where(finite("embedding"))
    width = usable.agg(F.max(F.size("embedding"))).first()[0]
    rows = usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not rows:
        return np.zeros((PARTS, 0, 0), dtype=np.int64)
    w = -(-width // PARTS)
    x = np.zeros((len(rows), PARTS * w))
    for row, (v,) in zip(x, rows, strict=True):
        row[: len(v)] = v
    return as_array(whole(x, SCALE).reshape(len(rows), PARTS, w).swapaxes(0, 1).tolist()) if w else np.zeros((PARTS, len(rows), 0), dtype=np.int64)


def codes(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each usable vector."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    small_batches(embeddings.sparkSession, 4096)
    books, before, rows = _books(vectors, entries), None, vectors
    if not books.shape[1]:
        return vectors.where("false").selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    for _ in range(rounds):
        step = keep(rows.mapInArrow(_stepped(books, before), f"{schema}, {STATE}"), "vector-bounds")
        if before is not None:
            forget(rows)
        rows, before = step, books
        parts, size, w = books.shape
        totals = added(rows.select("embedding", "codes").mapInArrow(_sums(books), TOTALS), parts * size * (w + 1)).reshape(parts, size, w + 1)
        books = as_array([[[t // e[-1] for t in e[:-1]] if e[-1] else old for e, old in zip(part, olds, strict=True)] for part, olds in zip(totals.tolist(), books.tolist(), strict=True)])
        books = books.reshape(parts, size, w)
    last = keep(rows.mapInArrow(_stepped(books, before, last=True), f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"), "vector-codes")
    if before is not None:
        forget(rows)
    whole_sum = F.when(F.max(F.col("error").isNull()), None).otherwise(F.sum(F.col("error").cast("decimal(38,0)")))
    sums = last.groupBy(F.col("label").alias("_label")).agg(whole_sum.alias("_sum"))
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    joined = last.join(sums, F.col("label").eqNullSafe(F.col("_label")))  # a hot label is split as a skewed join, or its few sums are sent to the rows
    fits = F.when(F.col("_sum") < F.lit(2**63 - 1).cast("decimal(38,0)") + 1, F.col("_sum")).cast("long")
    return joined.select("vec_id", "code", "error", fits.alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def codes_sql(entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same for DuckDB, for vectors of one length that 16 divides."""
    near = "select s.row, s.p, s.e, min({{'d': list_sum(list_transform(list_zip(s.e, c.e), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint, 'c': c.c}}) as n from s join c{0} c on c.p = s.p group by s.row, s.p, s.e"
    steps = [
        "k as (select vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding))",
        f"v as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 as row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from k)",
        f"s as materialized (select row, p, list_slice(e, p * (len(e) // {PARTS}) + 1, (p + 1) * (len(e) // {PARTS})) as e from v, range({PARTS}) as r(p))",
        f"c0 as materialized (select row as c, p, e from s where row < {entries})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} as materialized ({near.format(i)})")
        steps.append(f"d{i} as (select p, n.c as c, unnest(e) as x, generate_subscripts(e, 1) as i from a{i})")
        steps.append(f"t{i} as (select p, c, i, sum(x)::hugeint as s, count(*)::hugeint as n from d{i} group by p, c, i)")
        steps.append(f"m{i} as (select p, c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as e from t{i} group by p, c)")
        steps.append(f"c{i + 1} as materialized (select o.c, o.p, coalesce(m.e, o.e) as e from c{i} o left join m{i} m using (p, c))")
    steps.append(f"f as materialized ({near.format(rounds)})")
    steps.append("g as (select v.vec_id, v.label, string_agg(printf('%02x', f.n.c), '' order by f.p) as code, sum(f.n.d)::bigint as error from f join v using (row) group by v.row, v.vec_id, v.label)")
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(array_to_string(e, ','), ',' order by p, c)) from c{rounds}) as codebooks_sha256 from g"
