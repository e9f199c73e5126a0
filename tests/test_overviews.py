import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from factloom.sources import overviews


@pytest.fixture
def server():
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            key = self.path.rsplit("/", 1)[1]
            seen.append((time.time(), key))
            tries = sum(k == key for _, k in seen)
            status = 404 if key.startswith("gone") else 503 if key == "busy" and tries < 3 else 500 if key == "down" else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(f'{{"name": "{key}"}}'.encode())

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/v1/{{key}}", seen
    http.shutdown()


KEYS = ["A", "B C", "gone1", "busy", "down", "D", "E", "A", "F"]


def check(rows, seen, spacing):
    got = {r.key: (r.status, r.body, r.failure, r.attempts) for r in rows}
    assert len(rows) == len(got) == 8
    assert got["A"] == (200, '{"name": "A"}', None, 1) and got["B C"][1] == '{"name": "B%20C"}'
    assert got["gone1"] == (404, None, "HTTP 404", 1) and got["down"] == (500, None, "HTTP 500", 3) and got["busy"][0] == 200 and got["busy"][3] == 3
    times = sorted(t for t, _ in seen)
    assert len(times) == 12
    # sent at the starts of different slots; the server may see them a little late
    assert len({int((t + 0.01) / spacing) for t in times}) >= len(times) - 1
    assert times[-1] - times[0] >= (len(times) - 1.5) * spacing


def test_data_source_keeps_the_spacing(spark, server):
    url, seen = server
    rows = overviews.read_overviews(spark, url, KEYS, spacing=0.25, partitions=3).collect()
    check(rows, seen, 0.25)


def test_table_of_keys(spark, server):
    url, seen = server
    keys = spark.createDataFrame([(k, 1) for k in KEYS] + [(None, 2)], "ticker string, key int")
    rows = overviews.fetch_overviews(keys, "ticker", url, 2, spacing=0.25).collect()
    check(rows, seen, 0.25)
    assert overviews.fetch_overviews(keys.limit(0), "ticker", url, 2, spacing=0.25).count() == 0


def test_unreachable_server_fails_by_key(spark):
    rows = overviews.read_overviews(spark, "http://127.0.0.1:9/{key}", ["A"], spacing=0.05, attempts=2).collect()
    assert [(r.key, r.status, r.body, r.attempts) for r in rows] == [("A", None, None, 2)] and rows[0].failure
    assert overviews.read_overviews(spark, "http://127.0.0.1:9/{key}", [], spacing=0.05).count() == 0


def test_slots_of_all_partitions_differ():
    now = [100.03]
    sent = []
    parts = [overviews.Slots(0.5, i, 4, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)) for i in range(4)]
    for i in (2, 0, 0, 3, 1, 1, 2, 3, 0):
        parts[i].wait()
        sent.append(now[0])
    assert all(b - a >= 0.5 - 1e-9 for a, b in zip(sent, sent[1:], strict=False))
