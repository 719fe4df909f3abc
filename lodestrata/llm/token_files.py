"""Token-ID files: flat unsigned integers beside 64-bit document offsets, read back by memory map.

Layout of a corpus folder: for each part `<name>.tok` (ids, unsigned 16 or 32 bit, little endian),
`<name>.off` (n + 1 signed 64-bit offsets of its documents, counted in ids from the start of the corpus) and
`<name>.doc` (Arrow file: doc_id, n_tokens), and `manifest.json` with the parts in order and their bases.

Edge cases: a null text counts as empty and gives the end id alone; a null doc_id sorts first and stays null;
rows that share a doc_id are kept, ordered by a hash of their text; a text of any length is one document; an empty
table gives no rows and a manifest without parts; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import file_system, local_path, small_batches, tidy
from lodestrata.llm.tokens import encoder, in_slices

_PART = "pid int, name string, n_docs long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(folder: str, tokenizer: str, end_id: int, dtype: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = file_system(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"  # of this attempt alone
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        docs = tokens = 0
        out = index = None
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}.tok")
                index_file = fs.open_output_stream(f"{root}/{name}.doc")
                index = pa.ipc.new_file(index_file, schema)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = []
            for _, part in in_slices(texts):
                ids = enc.encode(part)
                flat = np.frombuffer(end.join([*ids, b""]), "<u4")  # an end id after each
                if int(flat.max()) > np.iinfo(dtype).max:
                    raise ValueError(f"id {flat.max()} does not fit into {dtype}")
                out.write(flat.astype(dtype).tobytes())
                sizes += [len(x) // 4 + 1 for x in ids]
            index.write_batch(pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            docs, tokens = docs + len(sizes), tokens + sum(sizes)
        if out is not None:
            for f in (out, index, index_file):
                f.close()
            yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n_docs": [docs], "n_tokens": [tokens]})

    return write


def _index(fs, root: str, name: str) -> pa.Table:
    with fs.open_input_file(f"{root}/{name}.doc") as f:
        return pa.ipc.open_file(f).read_all()


def _offsets(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = _index(fs, root, row["name"])["n_tokens"].to_numpy()
                offsets = row["base"] + np.concatenate([[0], np.cumsum(sizes)])
                with fs.open_output_stream(f"{root}/{row['name']}.off") as f:
                    f.write(offsets.astype("<i8").tobytes())
            yield batch.select(["name"])

    return write


class _Ranges:
    """A flat file of another store, read range by range."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, root = file_system(folder)
        self.file, self.dtype = fs.open_input_file(f"{root}/{name}"), np.dtype(dtype)

    def __getitem__(self, at: slice) -> np.ndarray:
        lo, hi = int(at.start), int(at.stop)
        return np.frombuffer(self.file.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)


def _flat(folder: str, name: str, dtype: str) -> np.ndarray | _Ranges:
    """A flat file: mapped where the store is a file system, else read as far as it is asked for."""
    path = local_path(folder)
    return np.memmap(f"{path}/{name}", dtype=dtype, mode="r") if path else _Ranges(folder, name, dtype)


def _reader(folder: str, dtype: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, all_offsets = _flat(folder, row["name"] + ".tok", dtype), _flat(folder, row["name"] + ".off", "<i8")
                docs = _index(fs, root, row["name"])["doc_id"].combine_chunks()
                base = int(all_offsets[0:1][0])
                for at in range(0, len(docs), 1024):
                    to = min(at + 1024, len(docs))
                    offsets = np.array(all_offsets[at : to + 1])
                    part, local = ids[int(offsets[0]) - base : int(offsets[-1]) - base], offsets - offsets[0]
                    crc = [zlib.crc32(part[local[i] : local[i + 1]].astype("<u4").tobytes()) for i in range(to - at)]
                    yield pa.RecordBatch.from_pydict({"doc_id": docs[at:to], "start": pa.array(offsets[:-1]), "n_tokens": pa.array(np.diff(offsets)), "ids_crc32": pa.array(crc, pa.int64())})

    return read


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> dict:
    """Encode docs (doc_id, text) and write them to folder in ascending doc_id order; returns the manifest. Ids are
    as wide as the largest of the tokenizer's, or end_id, needs; a wider one is refused, never cut.

    One range shuffle of the texts puts them in order; each task writes one part under a name of its own
    attempt, and only the parts that tasks report belong to the corpus, so a repeated task does no harm.
    The driver holds one row for each part, never one for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    largest = max(end_id, *encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values())
    if end_id < 0 or largest >= 1 << 32:
        raise ValueError(f"ids from 0 to {(1 << 32) - 1} only, not {min(end_id, 0) or largest}")
    dtype = "<u2" if largest < 1 << 16 else "<u4"
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").select("doc_id", "text")
    parts = sorted(ordered.mapInArrow(tidy(_writer(folder, tokenizer, end_id, dtype)), _PART).collect())
    bases = np.concatenate([[0], np.cumsum([p.n_tokens for p in parts], dtype=np.int64)]).tolist()
    rows = [(p.name, base) for p, base in zip(parts, bases, strict=False)]
    if rows:
        spread(spark, rows, "name string, base long").mapInArrow(_offsets(folder), "name string").write.format("noop").mode("overwrite").save()
    manifest = {"dtype": dtype, "end_id": end_id, "n_tokens": bases[-1], "parts": [{"name": p.name, "base": b, "n_docs": p.n_docs, "n_tokens": p.n_tokens} for p, b in zip(parts, bases, strict=False)]}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver rows over as many tasks as there are rows, up to the session's shuffle partitions."""
    n = max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.createDataFrame(rows, schema).repartition(n)


def read_token_files(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    rows = [(p["name"],) for p in manifest["parts"]]
    if not rows:
        return spark.createDataFrame([], _READ)
    return spread(spark, rows, "name string").mapInArrow(_reader(folder, manifest["dtype"]), _READ)


class TokenFiles:
    """Random access by document number, for a training loop; files are mapped when first touched."""

    def __init__(self, folder: str):
        fs, root = file_system(folder)
        with fs.open_input_file(f"{root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.folder, self.parts = folder, self.manifest["parts"]
        self.firsts = np.concatenate([[0], np.cumsum([p["n_docs"] for p in self.parts], dtype=np.int64)])
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return int(self.firsts[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.firsts, i, side="right")) - 1
        if k not in self._open:
            name = self.parts[k]["name"]
            self._open[k] = (_flat(self.folder, name + ".tok", self.manifest["dtype"]), _flat(self.folder, name + ".off", "<i8"))
        ids, offsets = self._open[k]
        at = i - int(self.firsts[k])
        base, (lo, hi) = int(offsets[0:1][0]), (int(x) for x in offsets[at : at + 2])
        return ids[lo - base : hi - base]
