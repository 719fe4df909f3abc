"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits over the 3-word shingles of a text. Bits are dealt into seven classes, numbered
1 to 7; table v keeps the bits of the classes whose number has odd parity with v. Two fingerprints that
differ in at most two bits have some v for which both differing bits are dropped (two classes span at most
a plane of three dimensions), so they meet in a bucket of that table: no pair is missed.

Buckets only say which fingerprints have any company. Those are linked exactly by midpoints: two
fingerprints differ in at most two bits if and only if some value is within one bit of both. Each emits
itself and its 64 neighbours, and all that share a value link to the smallest of them: at most 65
fingerprints can share one, so no group is large however many copies there are, and no pairs are formed.

Edge cases: a null or blank text has fingerprint zero and links like any other; one of fewer than three
words has its whole sequence as its only shingle; rows that share a doc_id are all returned; a null doc_id
is kept and never the smallest unless all of its component are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.shared import keep, small_batches, tidy

SHINGLE = 3
SEED = 42
#: 64 bits in seven classes; table v keeps the classes that have odd parity with it.
CLASS_OF_BIT = [1 + bit % 7 for bit in range(64)]
MASKS = [sum(1 << bit for bit in range(64) if (CLASS_OF_BIT[bit] & v).bit_count() % 2) for v in range(1, 8)]
_SLICE = 1 << 17


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of the 3-word shingles of a text, in order, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    return [xxh64_intdigest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if over half of the hashes have it."""
    counts, totals = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    pending: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        if pending:
            bits = np.unpackbits(np.array(pending, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, [at for _, at in owners], axis=0, dtype=np.int32)
            np.add.at(counts, [i for i, _ in owners], sums)
            pending.clear()
            owners.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text)
        totals[i] = len(hashes)
        for at in range(0, len(hashes), _SLICE):
            owners.append((i, len(pending)))
            pending.extend(hashes[at : at + _SLICE])
            if len(pending) >= _SLICE:
                flush()
    flush()
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = fingerprints_of(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(values.view(np.int64))], names=["doc_id", "tag", "fp"])


def fingerprints(docs: DataFrame, tag: Column | None = None) -> DataFrame:
    """doc_id, tag (a long that is carried along), fp (the 64 bits as a signed long) of each row of docs."""
    small_batches(docs.sparkSession)
    tag = F.lit(0) if tag is None else tag
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.cast("long").alias("tag"), "text").mapInArrow(tidy(_fingerprint), "doc_id long, tag long, fp long")


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Distinct fp -> fp, root: the same root for all that chains of steps of at most two bits connect."""
    keys = F.array(*[F.struct(F.lit(v).cast("byte").alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(MASKS)])
    tables = fps.select("fp", F.inline(keys))
    met = keep(tables.groupBy("v", "key").agg(F.min("fp").alias("one"), F.max("fp").alias("other")).where("one <> other").select("v", "key"), "met")  # written, so that the join can split a large bucket
    company = keep(tables.join(met.hint("merge"), ["v", "key"], "left_semi").select("fp").distinct(), "company")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)])
    middles = company.select("fp", F.explode(near).alias("middle"))
    least = middles.groupBy("middle").agg(F.min("fp").alias("one"), F.max("fp").alias("other")).where("one <> other")
    edges = middles.join(least.select("middle", "one").hint("merge"), "middle").where("fp <> one").select(F.col("fp").alias("a"), F.col("one").alias("b"))
    return components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most
    two bits) of each row of docs. Copies share a fingerprint and are linked once, as one class."""
    return _classes(keep(fingerprints(docs), "fingerprints")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(of: DataFrame) -> DataFrame:
    """The rows of fingerprints(), with root (a fingerprint that names the component) and component_id."""
    distinct = keep(of.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = link_fingerprints(distinct.select("fp"))
    named = distinct.join(roots.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    low = keep(named.groupBy("root").agg(F.min("first").alias("component_id")), "low")
    classes = keep(named.join(low.hint("merge"), "root").select("fp", "root", "component_id"), "classes")
    return of.join(classes.hint("merge"), "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of the smallest doc_id, and of rows
    that share it the one of the smallest hash; a row that stands several times stays once."""
    tag = F.xxhash64(*docs.columns)
    found = _classes(keep(fingerprints(docs, tag), "fingerprints"))
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.tag").alias("_tag"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_own"), tag.alias("_hash"))
    met = rows.join(stays.hint("merge"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tag")))
    once = Window.partitionBy("_own", "_hash").orderBy("_tag")
    return met.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("row.*")
