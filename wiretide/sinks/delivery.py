"""The data source ``alerts``: a writer, for batches and streams, that delivers records to a receiver.

    records.write.format("alerts").mode("append").options(transport="tcp", host=..., port=..., ledger=...).save()

Rows are (claim, record).  ``transport`` is ``tcp`` or ``udp`` (syslog; TCP frames by counted octets), ``webhook`` (JSON by
POST, to ``url``, with an optional ``token``) or ``spool`` (counted-octet files under the ledger, for receivers that fetch).

A claim is delivered at most once, whatever runs again.  Before a record goes out, its claim is marked in the ``ledger``, a
folder that all executors share, and a record whose claim is marked is skipped.  The mark is taken back only where the
receiver cannot have the record: it could not be reached, or answered that it did not take it; then the sender tries again
up to ``retries`` times.  Where the outcome is not known (a connection that broke, an answer that never came) the mark
stays and the record counts as unknown.  Spooled records need no marks: a task's file counts once the commit has renamed it.

An unreachable receiver fails no job: each commit leaves a row of its counts and errors in the ledger, for ``deliveries``.
UDP is not acknowledged: what counts as sent has left this host, no more.  A null claim stands for the record itself; null
records are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..operators import aggregates, exports
from ..sources import storage

#: Records of one POST, and seconds before the first further try.
TOGETHER, PAUSE = 100, 0.2
DELIVERIES = "batch string, transport string, sent long, skipped long, unknown long, failed long, errors array<string>, aborted boolean"


class Unreachable(Exception):
    """The receiver does not have the records: they may be sent again."""


class Refused(Exception):
    """The receiver does not have the records and will not take them."""


@dataclass
class Delivered(WriterCommitMessage):
    """What became of a task's records."""

    sent: int = 0
    skipped: int = 0
    unknown: int = 0
    failed: int = 0
    errors: list[str] = field(default_factory=list)
    spooled: list[str] = field(default_factory=list)


class Ledger:
    """Marks of claims, one small file each."""

    def __init__(self, at: str) -> None:
        self.fs, self.base = storage.store(at)
        self.local = self.fs.type_name == "local"

    def file(self, claim: str) -> str:
        name = hashlib.sha256(claim.encode()).hexdigest()
        return f"{self.base}/claims/{name[:2]}/{name}"

    def take(self, claim: str) -> bool:
        """Mark a claim; False if it is marked.  On a local or mounted file system one of several takers gets it."""
        from pyarrow import fs

        at = self.file(claim)
        self.fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        if self.local:
            try:
                os.close(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        if self.fs.get_file_info(at).type != fs.FileType.NotFound:
            return False
        self.fs.open_output_stream(at).close()
        return True

    def give_back(self, claim: str) -> None:
        self.fs.delete_file(self.file(claim))

    def put(self, name: str, data: bytes) -> None:
        """A file, whole or not at all."""
        self.fs.create_dir(f"{self.base}/{name}".rsplit("/", 1)[0], recursive=True)
        temporary = f"{self.base}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            out.write(data)
        self.fs.move(temporary, f"{self.base}/{name}")


def framed(record: str) -> bytes:
    data = record.encode()
    return b"%d %s" % (len(data), data)


class Tcp:
    """Syslog over TCP.  A record whose sending broke off may have arrived; the next one gets a new connection."""

    together = 1

    def __init__(self, options: dict) -> None:
        self.to, self.timeout, self.socket = (options["host"], int(options["port"])), float(options.get("timeout", 5)), None

    def send(self, records: list[str]) -> None:
        if self.socket is None:
            try:
                self.socket = socket.create_connection(self.to, self.timeout)
            except OSError as e:
                raise Unreachable(f"{type(e).__name__}: {e}") from e
        try:
            self.socket.sendall(b"".join(map(framed, records)))
        except OSError:
            self.close()
            raise

    def close(self) -> None:
        if self.socket is not None:
            self.socket.close()
            self.socket = None


class Udp(Tcp):
    """Syslog over UDP: one datagram for each record."""

    def send(self, records: list[str]) -> None:
        try:
            family, kind, _, _, to = socket.getaddrinfo(*self.to, type=socket.SOCK_DGRAM)[0]
            self.socket = self.socket or socket.socket(family, kind)
            for r in records:
                self.socket.sendto(r.encode(), to)
        except OSError as e:
            raise Refused(f"{type(e).__name__}: {e}") from e


class Webhook:
    """JSON by POST.  Answers of 408, 429 and 5xx, and a refused connection, may be tried again; other answers are final."""

    together = TOGETHER

    def __init__(self, options: dict) -> None:
        self.url, self.token, self.timeout = options["url"], options.get("token"), float(options.get("timeout", 5))
        if not self.url.startswith(("http://", "https://")):
            raise ValueError(f"{self.url} is no web address")

    def send(self, records: list[str]) -> None:
        body = json.dumps({"source": "wiretide", "count": len(records), "findings": [self.parsed(r) for r in records]}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            urllib.request.urlopen(urllib.request.Request(self.url, body, headers, method="POST"), timeout=self.timeout).close()
        except urllib.error.HTTPError as e:
            raise (Unreachable if e.code in (408, 429) or e.code >= 500 else Refused)(f"HTTP {e.code}") from e
        except urllib.error.URLError as e:
            if isinstance(e.reason, ConnectionRefusedError | socket.gaierror):
                raise Unreachable(str(e.reason)) from e
            raise OSError(str(e.reason)) from e

    def parsed(self, record: str):
        try:
            return json.loads(record)
        except ValueError:
            return record

    def close(self) -> None:
        pass


TRANSPORTS = {"tcp": Tcp, "udp": Udp, "webhook": Webhook}


def deliver(rows: Iterator, options: dict) -> Delivered:
    """Send the records of a task."""
    done, ledger, sender = Delivered(), Ledger(options["ledger"]), TRANSPORTS[options["transport"]](options)
    waiting: list[tuple[str, str]] = []

    def flush() -> None:
        outcome, tries = "failed", 0
        while waiting:
            try:
                sender.send([r for _, r in waiting])
                outcome = "sent"
            except Unreachable as e:
                if tries < int(options.get("retries", 3)):
                    time.sleep(PAUSE * 2**tries)
                    tries += 1
                    continue
                done.errors.append(str(e))
            except Refused as e:
                done.errors.append(str(e))
            except OSError as e:
                outcome = "unknown"
                done.errors.append(f"{type(e).__name__}: {e}")
            setattr(done, outcome, getattr(done, outcome) + len(waiting))
            if outcome == "failed":
                for claim, _ in waiting:
                    ledger.give_back(claim)
            waiting.clear()

    try:
        for row in rows:
            if row["record"] is None:
                continue
            claim = row["record"] if row["claim"] is None else row["claim"]
            if not ledger.take(claim):
                done.skipped += 1
                continue
            waiting.append((claim, row["record"]))
            if len(waiting) >= sender.together:
                flush()
        flush()
    except BaseException:
        for claim, _ in waiting:  # marked, but not sent: the task's next attempt sends them
            ledger.give_back(claim)
        raise
    finally:
        sender.close()
    return done


def spool(rows: Iterator, options: dict) -> Delivered:
    """Write the records of a task to a file that the commit will name."""
    fs, base = storage.store(options["ledger"])
    fs.create_dir(f"{base}/spool", recursive=True)
    name, n = f"spool/.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        for row in rows:
            if row["record"] is not None:
                out.write(framed(row["record"]))
                n += 1
    return Delivered(sent=n, spooled=[name])


class Writer:
    """What batch and stream writers share."""

    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        if self.options.get("transport") not in ("spool", *TRANSPORTS) or "ledger" not in self.options:
            raise ValueError("options: transport (spool, tcp, udp or webhook) and ledger")

    def write(self, iterator: Iterator) -> Delivered:
        return (spool if self.options["transport"] == "spool" else deliver)(iterator, self.options)

    def settle(self, messages: list, batch: str, aborted: bool = False) -> None:
        """Name what was spooled (or drop it), and leave the counts.  A batch that is committed again replaces its own."""
        ledger, done = Ledger(self.options["ledger"]), [m for m in messages if m is not None]
        for k, m in enumerate(done):
            for i, name in enumerate(m.spooled):
                if aborted:
                    ledger.fs.delete_file(f"{ledger.base}/{name}")
                else:
                    ledger.fs.move(f"{ledger.base}/{name}", f"{ledger.base}/spool/{batch}-{k:05d}-{i}.syslog")
        counts = {n: sum(getattr(m, n) for m in done) for n in ("sent", "skipped", "unknown", "failed")}
        errors = sorted({e for m in done for e in m.errors})
        ledger.put(f"deliveries/{batch}{'-aborted' * aborted}.json", json.dumps({"batch": batch, "transport": self.options["transport"], **counts, "errors": errors, "aborted": aborted}).encode())


class BatchWriter(Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.settle(messages, uuid.uuid4().hex)

    def abort(self, messages: list) -> None:
        self.settle(messages, uuid.uuid4().hex, aborted=True)


class StreamWriter(Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.settle(messages, f"batch-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self.settle(messages, f"batch-{batchId}", aborted=True)


class AlertSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alerts"

    def schema(self) -> str:
        return "claim string, record string"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))


def alert_records(findings: DataFrame, fmt: str = "syslog", floor: str = "high", limit: int = 100) -> DataFrame:
    """(claim, record) of the alerts worth sending; a session that has more than ``limit`` gets one record that says so.

    A claim is what its finding asserts: session, rule, subject and title."""
    chosen = exports.select_alerts(findings, floor, limit)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session_id", "rule_id", "subject_ip", "title")]
    known = aggregates.techniques(chosen)
    records = known.select(F.concat_ws("\x1f", *parts).alias("claim"), exports.FORMATS[fmt](known).alias("record"))
    more = chosen.where("suppressed > 0").groupBy("session_id").agg(F.max("suppressed").alias("n"), F.max("created").alias("created"))
    said = F.concat(F.col("n").cast("string"), F.lit(f" further findings of severity {floor} or above are withheld from session "), F.col("session_id").cast("string"))
    if fmt == "ecs":
        notice = F.to_json(F.struct(said.alias("message"), F.col("n").alias("withheld")))
    else:
        notice = F.concat(F.lit(f"<{exports.SYSLOG_FACILITY * 8 + 5}>1 - - wiretide - withheld - "), said)
    return records.unionByName(more.select(F.concat(F.lit("withheld\x1f"), F.col("session_id").cast("string"), F.lit("\x1f"), F.col("n").cast("string")).alias("claim"), notice.alias("record")))


def send(records: DataFrame, **options) -> None:
    """Deliver (claim, record) rows of a batch."""
    spark = records.sparkSession
    spark.dataSource.register(AlertSink)
    records.select("claim", "record").write.format("alerts").mode("append").options(**options).save()


def deliveries(spark: SparkSession, ledger: str) -> DataFrame:
    """A row for each batch that was delivered or given up."""
    return spark.read.schema(DELIVERIES).json(f"{ledger}/deliveries")


def spooled(spark: SparkSession, ledger: str) -> DataFrame:
    """The records of the spool."""

    def run(parts):
        import pandas as pd

        for part in parts:
            for path in part["path"]:
                out = []
                with storage.opened(path) as f:
                    data, at = f.read(), 0
                while at < len(data):
                    space = data.index(b" ", at)
                    end = space + 1 + int(data[at:space])
                    out.append(data[space + 1 : end].decode())
                    at = end
                yield pd.DataFrame({"record": out})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.syslog").load(f"{ledger}/spool").select("path")
    return files.mapInPandas(run, "record string")
