"""A list of unknown length read as a stream from a server here: to its end, on from there, and again after a restart."""

import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest

from lodestrata.sources import readers


@pytest.fixture
def server():
    items, asked = [], []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            offset = int(parse_qs(urlparse(self.path).query)["offset"][0])
            asked.append(offset)
            body = json.dumps([{"total": len(items)}, {"d": items[offset : offset + 10]}]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    at = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{at.server_address[1]}/?offset={{offset}}", items, asked
    at.shutdown()


def test_grows_and_resumes(spark, tmp_path, server):
    url, items, _ = server
    spark.dataSource.register(readers.PagedJson)
    out = str(tmp_path / "out")

    def run():
        lists = spark.readStream.format("paged_json").option("url", url).option("rows", 10).option("items", "1.d").load()
        q = lists.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return sorted(json.loads(r.payload)["id"] for r in spark.read.schema("page int, seq int, payload string").parquet(out).collect())

    assert run() == []
    for n in (34, 34, 57, 60, 61):  # ends within a page, nothing new, a page fills up, ends with a full page, one more
        items += [{"id": i} for i in range(len(items), n)]
        assert run() == list(range(n))
    last = spark.read.parquet(out).where("page = 6").collect()
    assert [(r.seq, r.payload) for r in last] == [(0, '{"id": 60}')]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 20, 79, 80, 81, 1234])
def test_end_is_found(server, n):
    url, items, asked = server
    items += [{"id": i} for i in range(n)]
    stream = readers._PagedStream({"url": url, "rows": "10", "items": "1.d"})
    assert stream.latestOffset() == stream.latestOffset() == {"rows": n}
    assert len(asked) < 40  # not page by page
    parts = stream.partitions({"rows": n // 3}, {"rows": n})
    assert [json.loads(p)["id"] for part in parts for *_, p in stream.read(part)] == list(range(n // 3, n))
