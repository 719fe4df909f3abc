"""Sources: versioned Parquet, typed CSV, JSON lists and lines, pages of landed REST responses, binary files."""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: HTTP statuses worth another try.
RETRY = {408, 409, 425, 429, 500, 502, 503, 504}


def versioned(spark: SparkSession, root: str, layer: str, name: str, version: str | None = None) -> DataFrame:
    """A dataset of a layer; one version is a partition, so the others are not read."""
    df = spark.read.parquet(f"{root}/{layer}/{name}")
    return df.where(F.col("dataset_version") == version) if version else df


def typed_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str], positive: list[str] = ()) -> DataFrame:
    """CSV with bad numbers as null, rows kept only where the required columns are there; a missing column raises."""
    raw = spark.read.csv(path, header=True)
    if gone := [f.name for f in schema if f.name not in raw.columns]:
        raise ValueError(f"missing columns: {gone}")
    df = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]).dropna(subset=required)
    for c in positive:
        df = df.where(F.col(c) > 0)
    return df


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds a list of objects; a missing or broken one gives no rows."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return text.select(F.inline(F.from_json("value", f"array<struct<{_fields(schema)}>>")))


def _fields(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(",")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("v")).select("v.*")


def fetched(url: str, tries: int = 5, wait: float = 0.5, opener: Callable = urllib.request.urlopen) -> dict | list:
    """JSON at a URL; temporary failures are tried again with growing waits up to 10 s."""
    for k in range(tries):
        try:
            with opener(url, timeout=60) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or k == tries - 1:
                raise
        except urllib.error.URLError:
            if k == tries - 1:
                raise
        time.sleep(min(10.0, wait * 2**k) * random.uniform(0.5, 1.0))  # so that many readers do not come back at once
    raise AssertionError("unreachable")


def paged_rows(url: str, rows: int = 100, items: str = "", first: int = 0, most: int | None = None, opener: Callable = urllib.request.urlopen) -> Iterator[tuple[int, int, str]]:
    """page, seq, payload of pages of a REST list until one is empty or shorter than asked for (or `most` pages are read). For
    lists whose length nobody tells: pages follow one another, so it is for one task or the driver."""
    page = first
    while most is None or page < first + most:
        found = _items(fetched(url.format(page=page, offset=page * rows), opener=opener), items)
        yield from ((page, i, json.dumps(x, sort_keys=True)) for i, x in enumerate(found))
        if len(found) < rows:
            return
        page += 1


def _items(found: dict | list, path: str) -> list[dict]:
    for key in filter(None, path.split(".")):
        found = found[int(key)] if isinstance(found, list) else found.get(key, [])
    return [v for v in (found.values() if isinstance(found, dict) else found) if isinstance(v, dict)]


def link_in_page(html: str, base: str, pattern: str = r"\.pdf(\?|$)") -> str | None:
    """The first link of a landing page whose address matches, made absolute; null if there is none."""
    import re
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    found: list[str] = []

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            href = dict(attrs).get("href")
            if tag == "a" and href and re.search(pattern, href, re.IGNORECASE):
                found.append(urljoin(base, href))

    Links().feed(html)
    return found[0] if found else None


def downloaded(urls: DataFrame, folder: str, tasks: int = 8, opener: Callable = urllib.request.urlopen, resolve: str | None = None) -> DataFrame:
    """urls (id, url) -> id, url, path, status (ok, exists, empty or failed), n_bytes, error. A file that is there is not fetched
    again; a new one is written beside its name and then renamed, so a repeated task leaves no half file. With resolve (a
    pattern), a page of HTML is read for a link that matches, and that is fetched. folder is one that all tasks share."""
    import pandas as pd

    def one(ident, url) -> tuple:
        path = os.path.join(folder, str(ident))
        if os.path.exists(path) and os.path.getsize(path):
            return ident, url, path, "exists", os.path.getsize(path), None
        try:
            with opener(url, timeout=60) as r:
                content = r.read()
            if resolve and content.lstrip()[:1] == b"<":
                if not (url := link_in_page(content.decode("utf-8", "replace"), url, resolve)):
                    return ident, url, None, "failed", 0, "no link in the page"
                with opener(url, timeout=60) as r:
                    content = r.read()
        except (OSError, ValueError) as e:
            return ident, url, None, "failed", 0, f"{type(e).__name__}: {e}"
        if not content:
            return ident, url, None, "empty", 0, None
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, path)
        return ident, url, path, "ok", len(content), None

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            yield pd.DataFrame([one(i, u) for i, u in zip(batch["id"], batch["url"], strict=True)], columns=["id", "url", "path", "status", "n_bytes", "error"])

    return urls.select(F.col("id").cast("string").alias("id"), "url").repartition(tasks).mapInPandas(run, "id string, url string, path string, status string, n_bytes long, error string")


class PagedJson(DataSource):
    """format("paged_json"): pages of a REST list. Options: url with {page} and {offset}, rows, pages, first, items (path of
    the list in a response, dots between). Each page is a partition; an empty one gives no rows. A row is page, seq, payload.

    As a stream it reads a list whose length nobody tells, up to its first empty page, and goes on from there when the list
    has grown: see _PagedStream. It takes no pages and no first."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, seq int, payload string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _PagedStream(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        first = int(self.options.get("first", 0))
        return [InputPartition(p) for p in range(first, first + int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, rows = partition.value, int(self.options.get("rows", 100))
        found = fetched(self.options["url"].format(page=page, offset=page * rows))
        for i, item in enumerate(_items(found, self.options.get("items", ""))):
            yield page, i, json.dumps(item, sort_keys=True)


class _PagedStream(DataSourceStreamReader):
    """An offset counts the rows of a list that only grows at its end: full pages, and what the last one holds so far, so a
    page that fills up later is read on from its middle. The driver looks for the last page that is not empty by doubling
    and halving steps; tasks read the pages, one each."""

    def __init__(self, options: dict):
        self.options, self.rows, self.last = dict(options), int(options.get("rows", 100)), 0

    def _page(self, page: int) -> list[dict]:
        return _items(fetched(self.options["url"].format(page=page, offset=page * self.rows)), self.options.get("items", ""))

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        found = self._page(self.last)
        if not found:
            return {"rows": self.last * self.rows}
        step = 1
        while more := self._page(self.last + step):
            found, self.last, step = more, self.last + step, 2 * step
        while step := step // 2:  # the last page is fewer than 2 * step pages on
            if more := self._page(self.last + step):
                found, self.last = more, self.last + step
        return {"rows": self.last * self.rows + min(len(found), self.rows)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = start["rows"], end["rows"]
        return [InputPartition((p, max(lo - p * self.rows, 0), min(hi - p * self.rows, self.rows))) for p in range(lo // self.rows, -(-hi // self.rows))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, lo, hi = partition.value
        for i, item in enumerate(self._page(page)[lo:hi], lo):
            yield page, i, json.dumps(item, sort_keys=True)


def binary_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Files parsed one by one into rows, with path, sha256, and an error instead of rows where parsing fails. The parser
    of a format (PDF pages, DICOM headers, OCR) is given from outside: none is part of this library."""
    from pyspark.sql.functions import udf

    inner = T.ArrayType(T.StructType.fromDDL(schema))

    @udf(T.StructType([T.StructField("rows", inner), T.StructField("error", T.StringType())]))
    def run(content):
        try:
            return parse(bytes(content)), None
        except Exception as e:  # noqa: BLE001
            return [], f"{type(e).__name__}: {e}"

    df = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), run("content").alias("r"))
    return df.select("path", "sha256", F.col("r.error").alias("error"), F.explode_outer("r.rows").alias("row")).select("path", "sha256", "error", "row.*")


def first_wins(precise: DataFrame, broad: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Both results of a query, the precise before the broad; the first row of each key stays, query_mode says whose it is."""
    from lodestrata.operators.ranking import top_k

    both = precise.withColumn("query_mode", F.lit("precise")).unionByName(broad.withColumn("query_mode", F.lit("broad")))
    return top_k(both, keys, [F.desc("query_mode"), F.col(seq)], 1)
