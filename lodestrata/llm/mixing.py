"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks of about BLOCK_DOCS by a seeded hash, and the blocks stand in a seeded order:
the source's list. A source whose target is q times its words has a quota of floor(q) turns of all of its blocks, and
as many more as reach the fraction left; the block in which that fraction ends gives the documents that fit, in hash
order. The tree deals these exact quotas among the output shards: a node splits its blocks between its two halves by
a multivariate-hypergeometric draw, down to single shards, so that every shard is a fair sample and all quotas
sum exactly. A shard draws the next blocks of each source's list: they are disjoint. What a document gives is what
its block was drawn for. In a shard, rows are shuffled by a seeded hash.

Scale: documents are reduced to their word counts in one pass without shuffling texts; rows alike are counted first
and numbered, COPIES at a time, so that each is a row of its own in some block. Rows are known by two 64-bit hashes. Blocks are ordered stretch by stretch with prefix sums
over the stretches, as many as each has blocks (the root of their number): no window runs over the documents of a source. Nodes hold only
sources with blocks left. The driver splits the first levels of the tree, up to NODES entries; tasks split what
is below, and give one row for each source of a shard. The driver holds one row for each source, MAX_SOURCES at most:
more are refused with a ValueError. Their rows are broadcast behind a check of their number, and beyond it joined
with salt. Beyond MAX_TURNS blocks in all (numpy's bound for a draw is 10^9) blocks grow instead.

Edge cases: a null text has no words; a null source is a source of its own, the last; empty tables give no
rows; documents without words are taken zero words; rows that share a doc_id, or all columns, are mixed each on its
own; a source without words has target zero; other columns are ignored, or carried by mixed() whatever their names, and
rows that differ in any of them are rows of their own; a text of any length is one document. The result depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.shared import keep, text_or_empty, words_of
from lodestrata.llm.token_files import spread

#: Fixed values of the contract: weights of the sources in order of code point, repeating; and the limits.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents of a block, about; words of a shard (some 50 MB of text).
BLOCK_DOCS = 16
SHARD_WORDS = 8_000_000
#: Blocks that the tree may deal in all; sources, and entries of nodes, that the driver may hold.
MAX_TURNS = 1 << 29
MAX_SOURCES = 1 << 20
NODES = 1 << 20
#: Up to so many sources their rows (about 100 bytes each) are broadcast; more are joined by merge, with salt.
BROADCAST_SOURCES = 20_000
SALTS = 64
#: Of rows alike, so many at a time are numbered, and given out, by one task.
COPIES = 1 << 16


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words that each source is to give: share of all by weight, none above most times its own."""
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(own[i] for i in free)
        over = {i for i in free if left * own[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * own[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def halves(lo: int, hi: int, have: np.ndarray, seed: int) -> np.ndarray:
    """What the first half of the shards lo to hi draws of the blocks that a node has."""
    total, mid = int(have.sum()), (lo + hi) // 2
    return np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, total * (mid - lo) // (hi - lo), method="marginals") if total else have


def splitting_tree(node: tuple, seed: int, most: int = 0) -> Iterator[tuple]:
    """The leaves below a node (lo, hi, sources, blocks, starts): shards lo to hi have so many blocks of each source,
    from a place of its list on. With `most`, nodes are left whole once they are so many, in order."""
    nodes = [node]
    if most:
        while len(nodes) < most and any(n[1] - n[0] > 1 for n in nodes):
            nodes = [child for n in nodes for child in (_children(n, seed) if n[1] - n[0] > 1 else [n])]
        yield from nodes
        return
    while nodes:
        n = nodes.pop()
        if n[1] - n[0] == 1:
            yield n
        else:
            nodes += _children(n, seed)[::-1]


def _children(node: tuple, seed: int) -> list[tuple]:
    lo, hi, sources, have, starts = node
    left = halves(lo, hi, have, seed)
    out = []
    for a, b, n, at in ((lo, (lo + hi) // 2, left, starts), ((lo + hi) // 2, hi, have - left, starts + left)):
        some = n > 0
        out.append((a, b, sources[some], n[some], at[some]))
    return out


_NODE = "lo long, hi long, sources array<long>, have array<long>, starts array<long>"


def _deal(seed: int):
    """Nodes -> source_no, shard, start, n: the places of each source's list that each shard draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, *arrays in zip(*[batch.column(c) for c in ("lo", "hi", "sources", "have", "starts")], strict=True):
                for shard, _, sources, n, starts in splitting_tree((lo.as_py(), hi.as_py(), *[a.values.to_numpy() for a in arrays]), seed):
                    yield pa.RecordBatch.from_arrays([pa.array(sources), pa.array(np.full(len(sources), shard)), pa.array(starts), pa.array(n)], names=["source_no", "shard", "start", "n"])

    return run


def _fill(block):
    """The documents of a source's last block that fit, in the order of their hash, into the words left."""
    block = block.sort_values(["at", "doc_id", "size"], kind="stable")
    left, got = float(block["room"].iloc[0]), []
    for size in block["size"]:
        got.append(size <= left)
        left -= size if got[-1] else 0
    if not all(got):  # one more if that ends nearer
        k = min((i for i, g in enumerate(got) if not g), key=lambda i: block["size"].iloc[i])
        got[k] = bool(block["size"].iloc[k] - left < left)
    return block.assign(got=got)


def _keys(seed: int) -> list[Column]:
    """Two hashes of doc_id, source and text."""
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.xxhash64("text"))
    return [place.alias("place"), F.xxhash64(F.lit(seed + 4), "text", "source", "doc_id").alias("also")]


def _row_keys(row: T.StructType, seed: int) -> list[Column]:
    """Two hashes of all fields of the struct row. A hash passes over nulls, so where they stand goes in too; nested fields go
    in as JSON, which tells theirs."""
    parts = []
    for f in row.fields:
        value = F.col(f"row.`{f.name}`")
        value = value if f.dataType.typeName() not in ("array", "map", "struct", "variant") else F.to_json(F.struct(value))
        parts += [value.isNull(), value]
    return [F.xxhash64(F.lit(seed), *parts).alias("one"), F.xxhash64(F.lit(seed + 4), *parts[::-1]).alias("two")]


def _copies(sized: DataFrame, most: int) -> DataFrame:
    """A row for each of the m rows alike, numbered by copy. Where they are many, several tasks number them."""
    few = sized.where(F.col("m") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    if most <= COPIES:
        return few
    many = sized.where(F.col("m") > COPIES).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition("place", "also", "_from")
    return few.unionByName(many.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("m")) - 1))).drop("_from"))


def _with_plan(sized: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """sized with the plan's row of its source. Documents of a source that holds many are never dealt to one task."""
    if sources <= BROADCAST_SOURCES:
        return sized.join(F.broadcast(plan), sized.source.eqNullSafe(plan.source)).drop(plan.source)
    plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = sized.withColumn("_salt", F.pmod("at", F.lit(SALTS)).cast("int"))
    met = sized.join(plan.hint("merge"), (sized._salt == plan._salt) & sized.source.eqNullSafe(plan.source))
    return met.drop(plan.source, plan._salt, sized._salt)


def mix(docs: DataFrame, seed: int = 7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (the output shard of each time that the document is
    taken), orders (its key in the shuffle of each), place and also (hashes of the row) and copy (its number among the m rows
    alike), one row for each row of docs (doc_id, source, text)."""
    sized = _sized(docs.select("doc_id", "source", "text", *_keys(seed)))
    return _mix(sized, _most(sized), seed, shard_words)


def _sized(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, place, also, more columns, and m, the number of rows alike in these."""
    sized = rows.select("doc_id", "source", F.size(words_of(text_or_empty())).cast("long").alias("size"), "place", "also", *more)
    return keep(sized.groupBy("doc_id", "source", "size", "place", "also", *more).agg(F.count("*").alias("m")), "sizes")


def _most(sized: DataFrame) -> int:
    return sized.agg(F.max("m")).first()[0] or 0


def _mix(sized: DataFrame, most: int, seed: int, shard_words: int) -> DataFrame:
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.sum("m").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    if not rows:
        none = F.array().cast
        return sized.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), none("array<long>").alias("shards"), none("array<long>").alias("orders"), "place", "also", F.col("m").alias("copy"), "m")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    goal = targets([r.words for r in rows])
    a_block = max(BLOCK_DOCS, -(-2 * sum(r.n for r in rows) // MAX_TURNS))
    per = [(i, r.source, r.words, t, -(-r.n // a_block), int(t // r.words) if r.words else 0) for i, (r, t) in enumerate(zip(rows, goal, strict=True))]
    plan = spark.createDataFrame(per, "source_no long, source string, source_size long, target double, blocks long, times int")
    rows = _copies(sized, most).withColumn("at", F.xxhash64(F.lit(seed + 1), "place", "copy"))
    placed = _with_plan(rows, plan, len(per)).withColumn("block", F.pmod("at", F.col("blocks")))
    block = placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("times").alias("times"), F.first("blocks").alias("blocks"))
    order = F.xxhash64(F.lit(seed + 2), "source_no", "block")
    stretch = F.floor(F.shiftrightunsigned("order", 33).cast("long") * F.ceil(F.sqrt(F.col("blocks"))) / (1 << 31))  # equal parts of the order
    block = keep(block.withColumn("order", order).withColumn("stretch", stretch).drop("blocks"), "block-words")
    earlier = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = block.groupBy("source_no", "stretch").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    base = base.select("source_no", "stretch", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("blocks_before"))
    within = Window.partitionBy("source_no", "stretch").orderBy("order", "block")
    so_far = F.col("words_before") + F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    block = block.join(base.hint("merge"), ["source_no", "stretch"]).withColumn("so_far", so_far).withColumn("rank", F.col("blocks_before") + F.row_number().over(within) - 1)
    extra = F.col("target") - F.col("times") * F.col("source_size")
    block = keep(block.withColumn("room", extra - (F.col("so_far") - F.col("words"))).select("source_no", "block", "rank", "times", "words", "room"), "blocks")
    # room: words that the block may still give beyond the whole times; part of it where it is less than the block has
    totals = block.groupBy("source_no").agg(F.count("*").alias("n"), F.max("times").alias("times"), F.sum((F.col("room") > 0).cast("long")).alias("more"))
    totals = {r.source_no: (r.n, r.n * r.times + r.more) for r in totals.collect()}  # one row a source
    quotas = np.array([totals[i][1] for i in range(len(per))], dtype=np.int64)
    some = np.flatnonzero(quotas)
    shards = max(1, -(-int(sum(goal)) // shard_words))
    nodes = splitting_tree((0, shards, some, quotas[some], np.zeros(len(some), np.int64)), seed, max(1, NODES // max(1, len(some))))
    dealt = spread(spark, [(lo, hi, *(a.tolist() for a in rest)) for lo, hi, *rest in nodes], _NODE).mapInArrow(_deal(seed), "source_no long, shard long, start long, n long")
    draws = dealt.select("source_no", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("turn"))
    # a block's k-th turn is at place k * n + rank of its source's list
    lists = spark.createDataFrame([(i, n) for i, (n, _) in totals.items()], "source_no long, listed long")
    lists = F.broadcast(lists) if len(per) <= BROADCAST_SOURCES else lists.hint("merge")
    turns = F.sequence(F.lit(0), F.col("times") + (F.col("room") > 0).cast("int") - 1)
    turns = block.where("times > 0 or room > 0").join(lists, "source_no").select("source_no", "block", F.posexplode(turns).alias("k", "_k"), "rank", "listed")
    drawn = turns.select("source_no", "block", "k", (F.col("k") * F.col("listed") + F.col("rank")).alias("turn")).join(draws.hint("merge"), ["source_no", "turn"])
    drawn = drawn.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("k", "shard")))["shard"].alias("shards"))  # three turns at most
    block = keep(block.join(drawn.hint("merge"), ["source_no", "block"], "left"), "drawn").withColumn("shards", F.coalesce("shards", F.array().cast("array<long>")))
    out = placed.join(block.drop("times", "rank").hint("merge"), ["source_no", "block"])
    inside = out.where("room > 0 and room < words")  # the last block of each source: document by document
    inside = inside.groupBy("source_no").applyInPandas(_fill, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inside.schema.fields) + ", got boolean")
    whole = out.where("not (room > 0 and room < words)").withColumn("got", F.col("room") > 0)
    every = whole.unionByName(inside).withColumn("shards", F.when(F.col("got") | (F.col("room") <= 0), F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.col("times"))))
    orders = F.transform("shards", lambda _, k: F.xxhash64(F.lit(seed + 3), "at", k))
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards", orders.alias("orders"), "place", "also", "copy", "m")


def _numbered(kinds: DataFrame) -> DataFrame:
    """kinds with first: rows before them among those of one place, in the order of their hashes. These are counted by parts
    of the hashes first, so that no task sorts all."""
    kinds = kinds.select("place", "also", "one", "two", "m", F.shiftrightunsigned("one", 52).alias("of"))
    earlier = Window.partitionBy("place", "also").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    base = kinds.groupBy("place", "also", "of").agg(F.sum("m").alias("n")).select("place", "also", "of", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("place", "also", "of").orderBy("one", "two").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("m").over(within), F.lit(0))
    return kinds.join(base.hint("merge"), ["place", "also", "of"]).withColumn("first", first).drop("of", "base")


def mixed(docs: DataFrame, seed: int = 7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself: row (a struct of all columns of docs) once for each time taken, shard and at (the sort key
    of the shuffle within a shard). Texts are shuffled once, by the hashes of their rows; of rows alike in every column one
    is sent, and given out as often as they are taken."""
    whole = docs.select(F.struct("*").alias("row"))
    whole = whole.select("row", *[F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text")]).select("*", *_keys(seed), *_row_keys(docs.schema, seed))
    kinds = _sized(whole.drop("row"), "one", "two")
    sized = keep(kinds.groupBy("doc_id", "source", "size", "place", "also").agg(F.sum("m").alias("m")), "sizes")
    turns = _mix(sized, _most(sized), seed, shard_words).select("place", "also", "copy", F.inline(F.arrays_zip(F.col("shards").alias("shard"), F.col("orders").alias("at"))))
    most = _most(kinds)
    own = _copies(_numbered(kinds), most).select("place", "also", (F.col("first") + F.col("copy")).alias("copy"), "one", "two", "m", F.floor(F.col("copy") / COPIES).alias("part"))
    turns = turns.join(own.hint("merge"), ["place", "also", "copy"]).select("one", "two", "m", "part", "shard", "at")
    rows = whole.groupBy("one", "two").agg(F.first("row").alias("row"), F.count("*").alias("m"))
    if most <= COPIES:
        return rows.drop("m").join(turns.hint("merge"), ["one", "two"]).select("row", "shard", "at")
    turns = keep(turns, "turns")
    few = rows.where(F.col("m") <= COPIES).drop("m").join(turns.where(F.col("m") <= COPIES).hint("merge"), ["one", "two"])
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES)))
    many = rows.where(F.col("m") > COPIES).withColumn("part", parts).drop("m").join(turns.where(F.col("m") > COPIES).hint("merge"), ["one", "two", "part"])
    return few.select("row", "shard", "at").unionByName(many.select("row", "shard", "at"))


def shuffled(mixed_rows: DataFrame) -> DataFrame:
    """mixed() in order: shard by shard, and shuffled within each."""
    return mixed_rows.repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")
