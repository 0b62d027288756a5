"""Service calls: each query is answered once, whatever fails."""

import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest

from tessera.recon import reconcile
from tessera.recon.calls import Ledger, ServiceError, post


class Service:
    """Every third call fails, some without an answer; what is answered is counted."""

    def __init__(self):
        self.answered, self.calls, self.at_once, self.most, self.lock = Counter(), 0, 0, 0, threading.Lock()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                text = self.rfile.read(int(self.headers["Content-Length"])).decode()
                asked = json.loads(parse_qs(text)["queries"][0])
                with service.lock:
                    service.calls += 1
                    service.at_once += 1
                    service.most = max(service.most, service.at_once)
                    fail = service.calls % 3 == 0
                time.sleep(0.05)
                with service.lock:
                    service.at_once -= 1
                    if not fail:
                        service.answered.update(q["query"] for q in asked.values())
                bad = any(q["query"] == "refused" for q in asked.values())
                self.send_response(400 if bad else 503 if fail else 200)
                self.end_headers()
                if not fail and not bad:
                    self.wfile.write(json.dumps({k: {"result": [{"id": f"http://x/{len(q['query'])}", "name": q["query"], "score": 90}]} for k, q in asked.items()}).encode())

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/reconcile"


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def test_each_query_is_answered_once(spark, service):
    values = [f"value {'x' * (k % 9)}{k}" for k in range(120)]
    asked = reconcile.queries(spark.createDataFrame([(v,) for v in values * 2], "v string"), "v").repartition(6)
    found = reconcile.http_scores(asked, service.url, batch=7, pause=0.01, in_flight=3)
    first = sorted(map(tuple, found.collect()))
    assert sorted(map(tuple, found.collect())) == first  # a second action asks nothing
    assert Counter(q for q, *_ in first) == Counter(values)
    assert service.answered == Counter(values)
    assert service.calls > len(values) // 7
    assert service.most <= 3


def test_a_named_ledger_serves_later_runs(spark, service, tmp_path):
    asked = reconcile.queries(spark.createDataFrame([("a",), ("b",)], "v string"), "v").coalesce(1)
    for _ in range(2):
        assert reconcile.http_scores(asked, service.url, ledger=str(tmp_path), pause=0.01).count() == 2
    assert service.answered == Counter(["a", "b"])
    with pytest.raises(Exception, match="400"):
        reconcile.http_scores(reconcile.queries(spark.createDataFrame([("refused",)], "v string"), "v"), service.url, pause=0.01).collect()
    with pytest.raises(ValueError, match="mounted"):
        reconcile.http_scores(asked, service.url, ledger="hdfs://x/y")


def test_two_attempts_at_once_ask_once(tmp_path):
    book, asked, out = Ledger(str(tmp_path)), [], []

    def ask():
        asked.append(1)
        time.sleep(0.3)
        return {"n": len(asked)}

    threads = [threading.Thread(target=lambda: out.append(book.once(["b"], ask))) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert asked == [1]
    assert out == [{"n": 1}] * 6
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".json")] == []


def test_a_failed_or_dead_attempt_gives_way(tmp_path):
    book = Ledger(str(tmp_path), lease=0.2, in_flight=1)
    with pytest.raises(ZeroDivisionError):
        book.once(["b"], lambda: 1 // 0)
    assert os.listdir(tmp_path) == []
    (claim,) = _claimed(book)
    assert claim.endswith(".claim")
    assert book._made("place-0")  # the dead task held this too
    assert book.once(["b"], lambda: "late") == "late"


def _claimed(book):
    """The claim of batch ["b"] as an attempt leaves it that dies inside."""

    def die():
        raise KeyboardInterrupt

    left = []
    try:
        book.once(["b"], lambda: left.extend(n for n in os.listdir(book.folder) if n.endswith(".claim")) or die())
    except KeyboardInterrupt:
        pass
    for name in left:
        assert book._made(name)
    return left


def test_pauses_and_faults(service):
    assert post(service.url, b"queries=%7B%7D", pause=0.01) == {}
    with pytest.raises(ServiceError):
        post("http://127.0.0.1:9/none", b"", attempts=2, pause=0.01)
