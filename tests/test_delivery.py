"""Delivery: framing, retries, and at most one delivery of a claim whatever fails in between."""

import http.server
import json
import socketserver
import threading
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from wiretide.sinks import delivery


@contextmanager
def serving(kind, handler):
    with kind(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        yield server
        server.shutdown()


class Threads(socketserver.ThreadingTCPServer):
    allow_reuse_address = True


@pytest.fixture
def syslog():
    """A receiver that takes counted octets; got: the records."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            while head := self.rfile.read(1):
                while not head.endswith(b" "):
                    head += self.rfile.read(1)
                self.server.got.append(self.rfile.read(int(head)).decode())

    with serving(Threads, Handler) as server:
        server.got = []
        yield server


@contextmanager
def webhook(answers):
    """A receiver that answers in turn; got: the bodies it took."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            code = answers.pop(0) if answers else 200
            if code == 200:
                self.server.got.append((json.loads(body), self.headers.get("Authorization")))
            if code:
                self.send_response(code)
                self.end_headers()
            else:  # took it, and never answers
                self.server.got.append((json.loads(body), None))

        def log_message(self, *args):
            pass

    with serving(http.server.ThreadingHTTPServer, Handler) as server:
        server.got = []
        yield server


def received(server, n):
    """What came, once there are n (or after some seconds)."""
    for _ in range(100):
        if len(server.got) >= n:
            break
        time.sleep(0.1)
    return sorted(server.got)


def frame(spark, n, start=0):
    return spark.createDataFrame([(f"c{i}", f"<1>1 récord\n{i}") for i in range(start, n)], "claim string, record string")


def total(spark, ledger, *columns):
    return tuple(delivery.deliveries(spark, ledger).agg(*[F.sum(c) for c in columns]).first())


def test_tcp_sends_each_claim_once(spark, tmp_path, syslog):
    to = {"transport": "tcp", "host": "127.0.0.1", "port": syslog.server_address[1], "ledger": str(tmp_path)}
    df = frame(spark, 40).unionByName(frame(spark, 3)).unionByName(spark.createDataFrame([(None, "no claim"), ("c99", None)], "claim string, record string"))
    for _ in range(2):
        delivery.send(df.repartition(4), **to)
    assert received(syslog, 41) == sorted([f"<1>1 récord\n{i}" for i in range(40)] + ["no claim"])
    assert total(spark, str(tmp_path), "sent", "skipped", "failed") == (41, 3 + 44, 0)


def test_a_task_that_failed_in_between_sends_the_rest(tmp_path, syslog):
    options = {"transport": "tcp", "host": "127.0.0.1", "port": str(syslog.server_address[1]), "ledger": str(tmp_path)}
    rows = [{"claim": f"c{i}", "record": f"r{i}"} for i in range(10)]

    def broken():
        yield from rows[:4]
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        delivery.BatchWriter(options).write(broken())
    done = delivery.BatchWriter(options).write(iter(rows))
    assert (done.sent, done.skipped) == (6, 4)
    assert received(syslog, 10) == [f"r{i}" for i in range(10)]


def test_an_unreachable_receiver_fails_no_job_and_gets_all_later(spark, tmp_path, syslog):
    to = {"transport": "tcp", "host": "127.0.0.1", "ledger": str(tmp_path), "retries": 1}
    delivery.send(frame(spark, 5).coalesce(1), port=1, **to)
    assert total(spark, str(tmp_path), "sent", "failed") == (0, 5)
    assert "ConnectionRefused" in delivery.deliveries(spark, str(tmp_path)).first()["errors"][0]
    delivery.send(frame(spark, 5).coalesce(1), port=syslog.server_address[1], **to)
    assert len(received(syslog, 5)) == 5


def test_udp(spark, tmp_path):
    class Handler(socketserver.BaseRequestHandler):
        def handle(self):
            self.server.got.append(self.request[0].decode())

    with serving(socketserver.ThreadingUDPServer, Handler) as server:
        server.got = []
        df = frame(spark, 5).unionByName(spark.createDataFrame([("big", "x" * 100_000)], "claim string, record string"))
        delivery.send(df.coalesce(1), transport="udp", host="127.0.0.1", port=server.server_address[1], ledger=str(tmp_path))
        assert len(received(server, 5)) == 5
    assert total(spark, str(tmp_path), "sent", "failed") == (5, 1)


def test_webhook_tries_again_only_what_was_not_taken(spark, tmp_path):
    with webhook([503, 429, 200]) as server:
        to = {"transport": "webhook", "url": f"http://127.0.0.1:{server.server_address[1]}/", "ledger": str(tmp_path / "a"), "token": "t"}
        delivery.send(frame(spark, 5).coalesce(1), **to)
        (body, auth), *more = server.got
        assert (body["count"], len(body["findings"]), auth, more) == (5, 5, "Bearer t", [])
    with webhook([400, 400]) as server:
        to |= {"url": f"http://127.0.0.1:{server.server_address[1]}/", "ledger": str(tmp_path / "b")}
        delivery.send(frame(spark, 150).coalesce(1), **to)
        assert server.got == []
        assert total(spark, str(tmp_path / "b"), "sent", "failed") == (0, 150)
    with webhook([None]) as server:  # the outcome is not known: no second try, now or later
        to |= {"url": f"http://127.0.0.1:{server.server_address[1]}/", "ledger": str(tmp_path / "c"), "timeout": "0.5"}
        for _ in range(2):
            delivery.send(frame(spark, 2).coalesce(1), **to)
        assert len(server.got) == 1
        assert total(spark, str(tmp_path / "c"), "sent", "unknown", "skipped") == (0, 2, 2)


def test_spool_and_aborted_spool(spark, tmp_path):
    at = str(tmp_path)
    delivery.send(frame(spark, 7).repartition(3), transport="spool", ledger=at)
    assert sorted(r.record for r in delivery.spooled(spark, at).collect()) == [f"<1>1 récord\n{i}" for i in range(7)]
    boom = F.raise_error(F.lit("no")).cast("string")
    with pytest.raises(Exception, match="no"):
        delivery.send(frame(spark, 7).repartition(3).withColumn("record", F.when(F.col("claim") == "c3", boom).otherwise(F.col("record"))), transport="spool", ledger=at)
    assert delivery.spooled(spark, at).count() == 7


def test_stream(spark, tmp_path, syslog):
    spark.dataSource.register(delivery.AlertSink)
    for k in range(2):
        frame(spark, 4 + 4 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("claim string, record string").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("alerts").options(transport="tcp", host="127.0.0.1", port=syslog.server_address[1], ledger=str(tmp_path / "l"))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(received(syslog, 8)) == 8
    assert {r.batch: r.sent for r in delivery.deliveries(spark, str(tmp_path / "l")).collect()} == {"batch-0": 4, "batch-1": 4}
    # a batch that is committed again finds its claims marked
    again = delivery.StreamWriter({"transport": "tcp", "host": "127.0.0.1", "port": str(syslog.server_address[1]), "ledger": str(tmp_path / "l")})
    assert again.write(iter([{"claim": "c1", "record": "x"}])).skipped == 1


def test_options():
    with pytest.raises(ValueError, match="transport"):
        delivery.BatchWriter({"transport": "pigeon", "ledger": "x"})
    with pytest.raises(ValueError, match="web address"):
        delivery.Webhook({"url": "ftp://x"})
