"""Reassembly against one byte at a time."""

import random

import pytest
from pyspark.sql import functions as F

from wiretide.operators import transport

SEGMENTS = "flow_id long, direction string, packet_no long, seq long, syn boolean, length long, payload binary"


def by_bytes(segments, limit):
    """What each place holds, in order of offset and arrival; the first to come is kept."""
    syn = [s for _, s, y, _ in segments if y]
    data = [(n, s, d) for n, s, y, d in segments if d]
    if not data:
        return [], [], [], 0, 0, False, False
    base = syn[-1] + 1 if syn else data[0][1]
    held, runs, gaps, conflicts, again, cut = {}, [], [], [], 0, False
    for off, n, d in sorted(((s - base) % 2**32, n, d) for n, s, d in data):
        top = max(held, default=None)
        if top is None or off > top + 1:
            if top is not None:
                gaps.append((top + 1, off - top - 1))
            runs.append(off)
            reach = off
        else:
            reach = top + 1
        size = min(len(d), reach - off)
        if size > 0:
            if all(held[off + i][0] == d[i] for i in range(size)):
                again += 1
            else:
                conflicts.append((off, size, held[off][1], n))
        for i in range(max(0, size), len(d)):
            held[off + i] = (d[i], n)
        if max(held) + 1 - runs[-1] >= limit:
            held = {k: v for k, v in held.items() if k < runs[-1] + limit}
            cut = True
            break
    out = []
    for r in runs:
        body = bytearray()
        while r + len(body) in held:
            body.append(held[r + len(body)][0])
        out.append((r, bytes(body)))
    return out, gaps, conflicts, again, len(held), cut, not syn


@pytest.mark.parametrize("limit", [1 << 25, 40])
def test_streams_equal_a_map_of_bytes(spark, limit):
    draw, rows, want = random.Random(4), [], {}
    for flow in range(80):
        text, start = bytes(draw.choices(b"ab", k=120)), draw.choice([0, 2**32 - 30, 1000])
        segments = [(0, (start - 1) % 2**32, True, b"")] if flow % 3 else []
        for n in range(1, draw.randrange(1, 14)):
            at = draw.randrange(110)
            d = text[at : at + draw.randrange(0, 30)]
            if draw.random() < 0.15:
                d = bytes(draw.choices(b"ab", k=len(d)))
            segments.append((n, (start + at) % 2**32, False, d))
        if not flow % 3:  # offsets count from the first segment: keep it the least
            segments = sorted(segments, key=lambda x: (x[1] - start) % 2**32)
            segments = [(n, s, y, d) for n, (_, s, y, d) in enumerate(segments) if d]
        rows += [(flow, "client", n, s, y, len(d), bytearray(d)) for n, s, y, d in segments]
        if segments:
            want[flow] = by_bytes(segments, limit)
    got = {}
    for r in transport.reassemble(spark.createDataFrame(rows, SEGMENTS).withColumn("extra", F.lit(1)).repartition(3), limit).collect():
        got[r.flow_id] = ([(x.offset, bytes(x.bytes)) for x in r.runs], [tuple(g) for g in r.gaps], [tuple(c) for c in r.conflicts], r.retransmissions, r.bytes_recovered, r.truncated, r.mid_stream)
    assert got == want
    assert sum(len(w[2]) for w in want.values()) > 5
