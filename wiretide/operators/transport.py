"""TCP byte streams and the cleartext protocols on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E

MAX_STREAM_BYTES = 32 << 20
# Cleartext and encrypted services by port.
CLEAR = {20: "ftp", 21: "ftp", 25: "smtp", 80: "http", 110: "pop3", 143: "imap", 587: "smtp", 8080: "http"}
ENCRYPTED = {443: "tls", 465: "tls", 993: "tls", 995: "tls", 8443: "tls"}


def protocol_of(port_a: Column, port_b: Column) -> Column:
    of = lambda p: F.coalesce(E._case(p, ENCRYPTED, None), E._case(p, CLEAR, None))
    return F.coalesce(of(port_a), of(port_b))


def conversation(packets: DataFrame, client: tuple[str, int], server: tuple[str, int], most: int = 2_000_000) -> DataFrame:
    """The segments of one conversation, for ``reassemble`` and ``stream_gaps``: packet_no, direction, seq, syn, length,
    payload.  The client is given, not taken from whichever address comes first.  At most the first ``most`` packets."""
    end = lambda ip, port, of: (F.col(ip) == of[0]) & (F.col(port) == of[1])
    up = end("src", "sport", client) & end("dst", "dport", server)
    down = end("src", "sport", server) & end("dst", "dport", client)
    p = packets.where((F.col("proto") == "TCP") & (up | down)).orderBy("packet_no").limit(most)
    return p.select(F.lit(1).cast("long").alias("flow_id"), F.when(up, "client").otherwise("server").alias("direction"), "packet_no", "seq", (F.col("tcp_flags").bitwiseAND(2) > 0).alias("syn"), F.length("payload").cast("long").alias("length"), "payload")


def caveats(streams: DataFrame) -> DataFrame:
    """flow_id, direction, caveat: what a reader of reassembled streams must know; no row where there is nothing.

    streams: what ``reassemble`` gives."""
    lost = F.aggregate("gaps", F.lit(0).cast("long"), lambda a, g: a + g.length.cast("long"))
    each = F.array_compact(F.array(
        F.when(F.size("gaps") > 0, F.format_string("%d bytes in %d gap(s) were not captured", lost, F.size("gaps"))),
        F.when(F.col("mid_stream"), "no opening was captured: earlier bytes are unknown"),
        F.when(F.size("conflicts") > 0, F.format_string("%d segment(s) contradict bytes that came before", F.size("conflicts"))),
        F.when(F.col("truncated"), "the stream was cut at the limit"),
    ))
    return streams.select("flow_id", "direction", F.explode(each).alias("caveat"))


def stream_gaps(segments: DataFrame) -> DataFrame:
    """flow_id, direction, offset, length of every gap, by a running end over segments in order; nothing is assembled.

    segments: flow_id, direction, packet_no, seq, syn, length.  Offsets count from the handshake, or else from the first
    segment, across the 32-bit wrap."""
    key = ["flow_id", "direction"]
    base = segments.groupBy(*key).agg(F.coalesce(F.min_by(F.col("seq") + 1, F.when(F.col("syn"), F.col("packet_no"))), F.min_by("seq", F.when(F.col("length") > 0, F.col("packet_no")))).alias("base"))
    s = segments.where("length > 0").join(base, key).withColumn("offset", F.pmod(F.col("seq") - F.col("base"), F.lit(1 << 32)))
    w = Window.partitionBy(*key).orderBy("offset", "packet_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("reached", F.max(F.col("offset") + F.col("length")).over(w))
    return s.where(F.col("offset") > F.col("reached")).select(*key, F.col("reached").alias("offset"), (F.col("offset") - F.col("reached")).alias("length"))


STREAMS = "flow_id long, direction string, runs array<struct<offset:long,bytes:binary>>, gaps array<struct<offset:long,length:long>>, conflicts array<struct<offset:long,length:long,kept_from:long,contradicted_by:long>>, retransmissions int, bytes_recovered long, truncated boolean, mid_stream boolean"


def reassemble(segments: DataFrame, limit: int = MAX_STREAM_BYTES) -> DataFrame:
    """One row for each flow and direction: runs of bytes, gaps, conflicts, retransmissions.

    A stream is a union of intervals.  Segments in order of their offsets (then of arrival) reach as far as the greatest end
    so far; a segment beyond that leaves a gap and opens a run; what it adds is its part beyond that, and the runs are these
    parts put together.  What a segment covers again is compared with the run: equal, it is a retransmission, else a
    conflict, of which the first arrival is kept.  A stream is held whole; one whose run comes to ``limit`` bytes ends there."""

    def build(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("packet_no", kind="stable")
        opening = pdf.loc[pdf["syn"], "seq"]
        data = pdf[pdf["payload"].map(lambda p: len(p or b"") > 0)]
        row = {"flow_id": key[0], "direction": key[1], "runs": [], "gaps": [], "conflicts": [], "retransmissions": 0, "bytes_recovered": 0, "truncated": False, "mid_stream": False}
        if len(data):
            base = int(opening.iloc[-1]) + 1 if len(opening) else int(data["seq"].iloc[0])
            data = data.assign(offset=(data["seq"].astype("int64") - base) % (1 << 32)).sort_values(["offset", "packet_no"], kind="stable")
            row |= union_of(data["offset"].to_numpy(), data["packet_no"].to_numpy(), [bytes(p) for p in data["payload"]], limit)
            row["mid_stream"] = not len(opening)
        return pd.DataFrame({k: pd.Series([v], dtype=object if isinstance(v, list) else None) for k, v in row.items()})

    def union_of(offset, packet, bodies, limit):
        import numpy as np

        end = offset + np.array([len(b) for b in bodies])
        reach = np.maximum.accumulate(end)
        before = np.concatenate([offset[:1], reach[:-1]])  # how far the stream reaches before each segment
        opens = np.concatenate([[True], offset[1:] > before[1:]])
        run = np.cumsum(opens) - 1
        starts = offset[opens]
        full = np.flatnonzero(reach - starts[run] >= limit)
        n = int(full[0]) + 1 if len(full) else len(bodies)
        adds = np.maximum(0, end - np.maximum(offset, before))[:n]
        parts = grouped(bodies, adds, run[:n])
        parts[-1] = parts[-1][:limit] if len(full) else parts[-1]
        again = np.flatnonzero((np.minimum(end, before) > offset)[:n] & ~opens[:n])
        differ = []
        for i in again.tolist():
            at, size = int(offset[i] - starts[run[i]]), int(min(end[i], before[i]) - offset[i])
            if parts[run[i]][at : at + size] != bodies[i][:size]:
                differ.append((i, size))
        giving = np.flatnonzero(adds > 0)  # segments that the bytes come from, by where they begin to
        owner = giving[np.searchsorted(np.maximum(offset, before)[giving], offset[[i for i, _ in differ]], side="right") - 1] if differ else []
        return {
            "runs": [{"offset": int(s), "bytes": b} for s, b in zip(starts, parts, strict=False) if b],
            "gaps": [{"offset": int(before[i]), "length": int(offset[i] - before[i])} for i in np.flatnonzero(opens[:n])[1:]],
            "conflicts": [{"offset": int(offset[i]), "length": size, "kept_from": int(packet[o]), "contradicted_by": int(packet[i])} for (i, size), o in zip(differ, owner, strict=True)],
            "retransmissions": len(again) - len(differ),
            "bytes_recovered": sum(map(len, parts)),
            "truncated": bool(len(full)),
        }

    def grouped(bodies, adds, run):
        parts: list[list[bytes]] = [[] for _ in range(int(run[-1]) + 1)]
        for b, k, r in zip(bodies, adds.tolist(), run.tolist(), strict=False):
            parts[r].append(b[len(b) - k :])
        return [b"".join(p) for p in parts]

    return segments.groupBy("flow_id", "direction").applyInPandas(build, STREAMS)



def transcript(streams: DataFrame, protocol: str) -> DataFrame:
    """Commands and replies, one row each.  streams: flow_id, direction ('client' or 'server'), text.  Bodies stay out;
    credentials are marked."""
    lines = streams.select("flow_id", "direction", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    # Commands that carry credentials, by protocol.
    secret = {"ftp": "PASS|ACCT", "smtp": "AUTH", "http": "AUTHORIZATION"}[protocol]
    if protocol == "http":
        w = Window.partitionBy("flow_id", "direction").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
        lines = lines.withColumn("body", F.coalesce(F.max(F.col("line") == "").over(w), F.lit(False))).where("NOT body AND line <> ''").drop("body")
        verb = F.regexp_extract("line", r"^([A-Za-z-]+)[: ]", 1)
        rest = F.regexp_extract("line", r"^[A-Za-z-]+:? ?(.*)$", 1)
    else:
        verb = F.when(F.col("direction") == "client", F.regexp_extract("line", r"^\s*([A-Za-z]{3,8})\b", 1)).otherwise(F.regexp_extract("line", r"^\s*(\d{3})[ -]?", 1))
        rest = F.when(F.col("direction") == "client", F.regexp_extract("line", r"^\s*[A-Za-z]{3,8}\s*(.*?)\s*$", 1)).otherwise(F.regexp_extract("line", r"^\s*\d{3}[ -]?(.*?)\s*$", 1))
    out = lines.withColumns({"verb": F.upper(verb), "rest": rest}).where("verb <> ''")
    return out.withColumn("sensitive", (F.col("direction") == "client") & F.col("verb").rlike(f"^(?:{secret})$")).drop("line")


def mail_envelope(events: DataFrame) -> DataFrame:
    """Senders and recipients of an SMTP transcript."""
    who = lambda verb, word: F.array_sort(F.collect_set(F.when((F.col("verb") == verb) & F.col("rest").rlike(f"(?i)^{word}:"), F.regexp_extract("rest", r"<([^>]*)>", 1))))
    return events.groupBy("flow_id").agg(who("MAIL", "FROM").alias("senders"), who("RCPT", "TO").alias("recipients"), F.max("sensitive").alias("credentials"))
