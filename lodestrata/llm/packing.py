"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Only the histogram of piece lengths decides how to pack: at most `capacity` lengths, whatever the number of
documents, so the plan is made on the driver. A reduction fixes sets that dominate every other set with the
same longest piece: one that fills the sequence exactly; a piece that nothing else fits beside; the largest
partner of a piece beside which only one fits; the largest partner of one beside which two fit, if no two
are larger together. What is left goes by best fit, longest first, all pieces of a length at once.

The plan is a list of runs: the pieces numbered lo to hi of a length go to consecutive sequences, so many
in each, from a given offset. A run uses up a length or a group of equal sequences, and each use of a group
at least halves the room left in it, so there are at most about 12 x 3 x capacity runs (150,000 for 4096):
their size is bounded by the capacity and is what each task gets. Pieces are numbered within their length by
task and place in the task; the bases of the tasks come from a window over counts, never over documents, and each task reads
its own from the shared folder, so pieces are not shuffled.

Edge cases: a null text counts as empty and gives the end id alone; rows that share a doc_id and null doc_ids
are packed like any other; a document longer than the capacity is cut into full pieces and a rest, and none
other is; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import file_system, keep, new_path, small_batches, tidy
from lodestrata.llm.tokens import encoder, in_slices

#: Tasks whose counts share a file.
TASKS = 64

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def _cut(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, enc = TaskContext.get().partitionId(), defaultdict(int), encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids_of = [t or "" for t in batch.column("text").to_pylist()]
            docs, cols = batch.column("doc_id").to_pylist(), defaultdict(list)
            for at, part in in_slices(ids_of):
                for i, ids in enumerate(enc.encode(part)):
                    ids += end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[lo : lo + 4 * capacity]
                        n = len(own) // 4
                        row = (docs[at + i], k, lo // 4, n, zlib.crc32(own), task, seen[n])
                        for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32", "task", "number"), row, strict=True):
                            cols[name].append(value)
                        if with_ids:
                            cols["ids"].append(np.frombuffer(own, "<u4").astype(np.int32))
                        seen[n] += 1
            types = {"piece": pa.int32(), "task": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()}) if cols else pa.RecordBatch.from_pydict({})

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document (doc_id, text), numbered within its task and length; ids with_ids.
    It is written to the shared folder at once, as the numbers belong to the tasks that made them."""
    small_batches(docs.sparkSession)
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_cut(tokenizer, end_id, capacity, with_ids)), schema), "pieces")


class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.runs, self.bins = capacity, [], 0
        self.left = {s: int(n) for s, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)

    def run(self, size: int, n: int, first: int, each: int, offset: int) -> None:
        self.runs.append((size, self.used[size], self.used[size] + n, first, each, offset))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.sizes[bisect_left(self.sizes, size)]

    def most(self, room: int, but: int) -> int:
        """The largest length that fits, of a piece other than one of length `but`; 0 if none does."""
        k = bisect_left(self.sizes, room + 1) - 1
        if k >= 0 and self.sizes[k] == but and self.left[but] < 2:
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def least(self, n: int, but: int) -> list[int]:
        """The n smallest lengths, repeats included, without one piece of length `but`."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n, self.left[s] - (s == but))
            if len(out) >= n:
                break
        return out[:n]

    def pair(self, a: int, b: int) -> None:
        if a == b:
            n = self.left[a] // 2
            self.run(a, 2 * n, self.bins, 2, 0)
        else:
            n = min(self.left[a], self.left[b])
            self.run(a, n, self.bins, 1, 0)
            self.run(b, n, self.bins, 1, a)
        self.bins += n

    def best_two(self, room: int, but: int) -> int:
        """The largest sum, up to room, of two pieces other than one of length `but`."""
        own = [s for s in self.sizes if s < room and (s != but or self.left[but] > 1)]
        if not own:
            return 0
        have = np.array(own)
        at = np.searchsorted(have, room - have, side="right") - 1
        enough = np.array([self.left[s] - (s == but) > 1 for s in own])
        same = (at == np.arange(len(have))) & ~enough
        at = np.where(same, at - 1, at)
        return int((have + have[at])[at >= 0].max(initial=0))

    def dominating(self, size: int) -> int | None:
        """The partner to fix beside a piece (0: none, alone), or None if nothing here is sure to dominate."""
        room = self.capacity - size
        partner = self.most(room, size)
        if not partner or partner == room:
            return partner
        small = self.least(3, size)
        if len(small) < 2 or small[0] + small[1] > room:
            return partner
        if (len(small) < 3 or sum(small) > room) and partner >= self.best_two(room, size):
            return partner
        return None

    def reduce(self) -> None:
        for size in [s for s in reversed(self.sizes) if 2 * s >= self.capacity]:  # exact complements first
            if self.left[size] and self.most(self.capacity - size, size) == self.capacity - size:
                if size < self.capacity:
                    self.pair(size, self.capacity - size)
        changed = True
        while changed:
            changed = False
            for size in list(reversed(self.sizes)):
                while self.left[size]:
                    partner = self.dominating(size)
                    if partner is None:
                        break
                    changed = True
                    if partner:
                        self.pair(size, partner)
                    else:
                        n = self.left[size]
                        self.run(size, n, self.bins, 1, 0)
                        self.bins += n

    def best_fit(self) -> None:
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = defaultdict(list)

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if not groups[room]:
                    insort(rooms, room)
                groups[room].append((first, n))

        for size in list(reversed(self.sizes)):
            while n := self.left[size]:
                k = bisect_left(rooms, size)
                if k == len(rooms):
                    room, first = self.capacity, self.bins
                    bins = -(-n // (room // size))
                    self.bins += bins
                else:
                    room = rooms[k]
                    first, bins = groups[room].pop()
                    if not groups[room]:
                        del rooms[k]
                each = room // size
                full, rest = min(bins, n // each), 0
                if full:
                    self.run(size, full * each, first, each, self.capacity - room)
                    put(room - each * size, first, full)
                if full < bins and (rest := n - full * each):
                    self.run(size, rest, first + full, rest, self.capacity - room)
                    put(room - rest * size, first + full, 1)
                put(room, first + full + (rest > 0), bins - full - (rest > 0))


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, lo, hi, first sequence, pieces in each, offset) and the number of sequences."""
    plan = _Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan.runs, plan.bins


def _place(runs: np.ndarray, bases: str):
    keys = (runs[:, 0] << 40) + runs[:, 1]

    def bases_of(task: int) -> np.ndarray:
        """Pieces of each length in earlier tasks: a table of one task, of capacity + 1 numbers at most."""
        fs, path = file_system(bases)
        rows = pq.read_table(f"{path}/part={task // TASKS}", filesystem=fs, columns=["length", "base"], filters=[("task", "=", task)], partitioning=None)
        length = rows.column("length").to_numpy()
        out = np.zeros(int(length.max()) + 1, np.int64)
        out[length] = rows.column("base").to_numpy()
        return out

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
        for batch in batches:
            length, number, task = (batch.column(c).to_numpy() for c in ("length", "number", "task"))
            number = number.copy()
            for t in np.unique(task).tolist():
                known = known if known[0] == t else (t, bases_of(t))
                number[task == t] += known[1][length[task == t]]
            own = runs[np.searchsorted(keys, (length << 40) + number, side="right") - 1] if len(runs) else np.zeros((0, 6), np.int64)
            k = number - own[:, 1]
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("task", "number")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(own[:, 3] + k // own[:, 4]), "offset": pa.array(own[:, 5] + k % own[:, 4] * length)})

    return place


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces of cut_pieces -> the same rows with sequence_id and offset in place of task and number. Pieces and their ids
    stay where they are: what a task needs of the other tasks' counts, it reads from the shared folder."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = keep(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    bases = new_path(spark, "bases")
    counts.select("task", "length", "base", F.floor(F.col("task") / TASKS).alias("part")).repartition("part").sortWithinPartitions("part", "task").write.partitionBy("part").parquet(bases)
    runs, _ = plan_packing(histogram, capacity)
    ordered = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    kept = [f for f in pieces.schema.fields if f.name not in ("task", "number")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return pieces.select(*[f.name for f in kept], "task", "number").mapInArrow(_place(ordered, bases), schema)
