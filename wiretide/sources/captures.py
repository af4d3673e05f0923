"""Packet captures (pcap and pcapng) to packet rows, and packet rows to captures.

A capture is cut into byte ranges, each a task of its own.  A range does not begin at a record, so its task looks for the
first place from which a chain of plausible records follows, and walks to the first record beyond its end.  The guess is
then checked: it has to be where the walk of the range before it ended, else the range is walked again from there.  The rows
are thus those of one reader that starts at the beginning, wherever the cuts fall.  The same pass counts the packets (so
that they can be numbered) and finds the interfaces that pcapng ranges inherit; a second one, the data source ``capture``,
decodes.  Files are listed by Spark and opened through Arrow's file systems.

A frame that holds no IP packet gives no row.  A file that is no capture, or declares an unsupported link type, is refused
whole: it gives no packets, and ``refusals`` names it with the reason; the other files are read.  A file that ends within a
record ends before it; an empty file or one shorter than a file header gives no rows."""

from __future__ import annotations

import io
import ipaddress
import json
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import storage

SCHEMA = "session_id long, packet_no long, ts double, src string, dst string, proto string, sport int, dport int, tcp_flags int, frame_len int, data_len int, seq long, payload binary"
# Link types by number, EtherTypes, IP protocol numbers.
ETHERNET, NULL, LOOP, RAW, SLL, SLL2, ONLY4, ONLY6 = 1, 0, 108, (12, 101), 113, 276, 228, 229
IPV4, IPV6, VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8, 0x9100)
SKIPPED_HEADERS, FRAGMENT = (0, 43, 51, 60), 44
# ICMP errors that may carry an extension, from which length on, and how much of the packet they then quote.
EXTENDED_ERRORS, EXTENDED_LEAST, QUOTED_MOST = (3, 11, 12), 144, 128
# First bytes of captures, and the most that is taken by upload.
MAGICS = ("d4c3b2a1", "a1b2c3d4", "4d3cb2a1", "a1b23c4d", "0a0d0d0a")
LARGEST_UPLOAD = 512 << 20
SUPPORTED = (ETHERNET, NULL, LOOP, *RAW, SLL, SLL2, ONLY4, ONLY6)


# File magics with their byte order and ticks a second; pcapng's section block, byte-order mark and block types.
PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION, MARK, BLOCKS = b"\x0a\x0d\x0d\x0a", b"\x4d\x3c\x2b\x1a", (1, 2, 3, 4, 5, 6, 10, 0x0A0D0D0A)
INTERFACE, PACKET = 1, 6
#: Bytes of a range; bytes read at a time; records that have to follow each other; longest record that is looked for.
RANGE, BLOCK, CHAIN, LONGEST = 128 << 20, 4 << 20, 12, 1 << 22


class Bytes:
    """A file of a known size, read in blocks; ``at`` gives fewer bytes than asked for only at the end."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.start, self.block = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place < self.start or place + n > self.start + len(self.block):
            self.file.seek(min(place, self.size))
            self.start, self.block = place, self.file.read(max(n, BLOCK))
        return self.block[place - self.start : place - self.start + n]


class Classic:
    """Records of a pcap file."""

    def __init__(self, head: bytes) -> None:
        self.end, self.unit = PCAP[head[:4]]
        self.link = struct.unpack_from(self.end + "I", head, 20)[0] & 0xFFFF
        self.header, self.first, self.step = struct.Struct(self.end + "4I"), 24, 1

    def size(self, f: Bytes, at: int, sure: bool = True) -> int:
        """Bytes of the record at a place; 0 if there is none.  Unless sure of the place, it has to look like one too."""
        head = f.at(at, 16)
        if len(head) < 16:
            return 0
        _, sub, kept, wire = self.header.unpack(head)
        if not sure and (sub >= self.unit or kept > LONGEST or not 0 < wire <= LONGEST or kept > wire):
            return 0
        return 16 + kept if at + 16 + kept <= f.size else 0

    def packet(self, f: Bytes, at: int, size: int, state: list) -> tuple | None:
        sec, sub, _, wire = self.header.unpack(f.at(at, 16))
        return f.at(at + 16, size - 16), (sec * self.unit + sub) / self.unit, self.link, wire

    def counts(self, f: Bytes, at: int) -> bool:
        return True

    def learn(self, f: Bytes, at: int, size: int, state: list) -> None:
        pass


class Blocks:
    """Blocks of a pcapng file.  The state is the byte order of the section and its interfaces (link type, ticks a second)."""

    first, step, link = 0, 4, None

    def size(self, f: Bytes, at: int, sure: bool = True) -> int:
        head = f.at(at, 12)
        if len(head) < 12:
            return 0
        if head[:4] == SECTION:
            orders = "<" if head[8:12] == MARK else ">"
        else:
            orders = self.order if sure else "<>"
        for end in orders:
            kind, size = struct.unpack_from(end + "II", head)
            if 12 <= size <= f.size - at and (sure or (size % 4 == 0 and size <= LONGEST and kind in BLOCKS and struct.unpack(end + "I", f.at(at + size - 4, 4))[0] == size)):
                self.order = end
                return size
        return 0

    order = "<"

    def counts(self, f: Bytes, at: int) -> bool:
        return struct.unpack(self.order + "I", f.at(at, 4))[0] == PACKET

    def learn(self, f: Bytes, at: int, size: int, state: list) -> None:
        """Sections and interfaces, as the state's further elements."""
        if f.at(at, 4) == SECTION:
            state.append([self.order])
        elif struct.unpack(self.order + "I", f.at(at, 4))[0] == INTERFACE and size >= 20:
            state.append(self.interface(f.at(at + 8, size - 12)))

    def interface(self, body: bytes) -> list[int]:
        unit, at = 10**6, 8
        while at + 4 <= len(body):
            code, n = struct.unpack_from(self.order + "HH", body, at)
            if code == 0:
                break
            if code == 9 and n and at + 4 < len(body):
                v = body[at + 4]
                unit = 2 ** (v & 0x7F) if v & 0x80 else 10**v
            at += 4 + (n + 3) // 4 * 4
        return [struct.unpack_from(self.order + "H", body)[0], unit]

    def packet(self, f: Bytes, at: int, size: int, state: list) -> tuple | None:
        """state: the interfaces of the section so far."""
        if size < 32:
            return None
        number, high, low, kept, wire = struct.unpack(self.order + "5I", f.at(at + 8, 20))
        if number >= len(state):
            return None
        link, unit = state[number]
        return f.at(at + 28, min(kept, size - 32)), ((high << 32) | low) / unit, link, wire


def kind_of(f: Bytes) -> Classic | Blocks | None:
    """How a file is read; None for one too short to hold anything."""
    head = f.at(0, 24)
    if len(head) < 24:
        return None
    if head[:4] == SECTION:
        return Blocks()
    if head[:4] not in PCAP:
        raise ValueError("not a capture file")
    return Classic(head)


def inherited(state: list) -> list:
    """The section and its interfaces out of all that was learned: what still holds at the end."""
    last = max((i for i, x in enumerate(state) if len(x) == 1), default=None)
    return state if last is None else state[last:]


def guess(f: Bytes, kind, lo: int, hi: int) -> int | None:
    """The first place of a range from which a chain of records follows, to the end of the file if that is near."""
    for at in range(-(-lo // kind.step) * kind.step, hi, kind.step):
        place, n = at, 0
        while n < CHAIN and place < f.size:
            size = kind.size(f, place, sure=False)
            if not size:
                break
            place, n = place + size, n + 1
        if n == CHAIN or (n and place == f.size):
            kind.size(f, at, sure=False)  # the byte order is that of the first record again
            return at
    return None


def walk(f: Bytes, kind, start: int, hi: int, state: list) -> tuple[int, int, list]:
    """Number of packets from a record on to the first record at or beyond hi; that one's place; what was learned."""
    at, n, learned = start, 0, []
    if isinstance(kind, Blocks) and state:
        kind.order = state[0][0]
    while at < hi:
        size = kind.size(f, at)
        if not size:
            return n, f.size, learned
        n += kind.counts(f, at)
        kind.learn(f, at, size, learned)
        at += size
    return n, at, learned


def frames(data: bytes) -> Iterator[tuple[bytes, float, int, int]]:
    """(frame, seconds, link type, length on the wire) of each captured packet of a file, in file order."""
    f = Bytes(io.BytesIO(data), len(data))
    kind = kind_of(f)
    if kind:
        yield from (p for _, p in packets_of(f, kind, kind.first, len(data), []))


def packets_of(f: Bytes, kind, start: int, hi: int, state: list) -> Iterator[tuple[int, tuple]]:
    """The number within the range, from 1, and the parts of each packet whose record starts in it."""
    at, n, interfaces = start, 0, [tuple(x) for x in state if len(x) == 2]
    if isinstance(kind, Blocks) and state:
        kind.order = state[0][0]
    while at < hi and (size := kind.size(f, at)):
        if kind.counts(f, at):
            n += 1
            p = kind.packet(f, at, size, interfaces)
            if p:
                yield n, p
        else:
            learned: list = []
            kind.learn(f, at, size, learned)
            for x in learned:
                interfaces = [] if len(x) == 1 else [*interfaces, tuple(x)]
        at += size


def network_layer(f: bytes, link: int) -> tuple[int, int]:
    """(EtherType, offset of the IP header); EtherType 0 if there is none."""
    try:
        if link == ETHERNET:
            kind, at, depth = struct.unpack_from("!H", f, 12)[0], 14, 0
            while kind in VLAN and depth < 4:
                kind, at, depth = struct.unpack_from("!H", f, at + 2)[0], at + 4, depth + 1
            return kind, at
        if link in RAW:
            return {4: IPV4, 6: IPV6}.get(f[0] >> 4, 0), 0
        if link == ONLY4 or link == ONLY6:
            return (IPV4 if link == ONLY4 else IPV6), 0
        if link == SLL:
            return struct.unpack_from("!H", f, 14)[0], 16
        if link == SLL2:
            return struct.unpack_from("!H", f, 0)[0], 20
        family = struct.unpack_from("<I" if link == NULL else "!I", f, 0)[0]
        return IPV4 if family == 2 else IPV6 if family in (10, 24, 28, 30) else 0, 4
    except (struct.error, IndexError):
        return 0, 0


def decode(f: bytes, link: int) -> tuple | None:
    """(src, dst, proto, sport, dport, flags, data_len, seq, payload) of a frame, or None without IP."""
    kind, at = network_layer(f, link)
    try:
        if kind == IPV4:
            header = (f[at] & 15) * 4
            if f[at] >> 4 != 4 or header < 20:
                return None
            total, fragment, number = struct.unpack_from("!H", f, at + 2)[0], struct.unpack_from("!H", f, at + 6)[0] & 0x1FFF, f[at + 9]
            src, dst = ".".join(map(str, f[at + 12 : at + 16])), ".".join(map(str, f[at + 16 : at + 20]))
            body, end = at + header, at + (total or len(f) - at)
        elif kind == IPV6:
            length, number, fragment = struct.unpack_from("!H", f, at + 4)[0], f[at + 6], 0
            src, dst = str(ipaddress.ip_address(f[at + 8 : at + 24])), str(ipaddress.ip_address(f[at + 24 : at + 40]))
            body, end = at + 40, at + 40 + (length or len(f))
            for _ in range(8):
                if number in SKIPPED_HEADERS:
                    step = (f[body + 1] + 2) * 4 if number == 51 else (f[body + 1] + 1) * 8
                    number, body = f[body], body + step
                elif number == FRAGMENT:
                    fragment = struct.unpack_from("!H", f, body + 2)[0] >> 3
                    number, body = f[body], body + 8
                else:
                    break
        else:
            return None
        if fragment:
            return src, dst, "OTHER", 0, 0, 0, 0, None, b""
        end = max(body, min(end, len(f)))
        if number == 6:
            sport, dport, seq = struct.unpack_from("!HHI", f, body)
            header = max(20, (f[body + 12] >> 4) * 4)
            data = f[min(body + header, end) : end]
            return src, dst, "TCP", sport, dport, f[body + 13], len(data), seq, data
        if number == 17:
            sport, dport = struct.unpack_from("!HH", f, body)
            data = f[min(body + 8, end) : end]
            return src, dst, "UDP", sport, dport, 0, len(data), None, data
        if number in (1, 58):
            kind, code = f[body], f[body + 1]
            data = f[min(body + {13: 20, 14: 20, 17: 12, 18: 12}.get(kind if number == 1 else 0, 8), end) : end]
            if number == 1 and kind in EXTENDED_ERRORS and end - body >= EXTENDED_LEAST:
                data = data[:QUOTED_MOST]  # what follows is the error's own extension
            return src, dst, "ICMP", 0, kind * 256 + code, 0, len(data), None, data
        return src, dst, "OTHER", 0, 0, 0, max(0, end - body), None, b""
    except (struct.error, IndexError):
        return None


def upload_problems(files: DataFrame) -> DataFrame:
    """files (path, length, head: the first bytes) with why each is not taken, or null."""
    known = F.lower(F.hex(F.substring("head", 1, 4))).isin(*MAGICS)
    return files.withColumn("problem", F.when(F.col("length") > LARGEST_UPLOAD, "too large").when(~F.coalesce(known, F.lit(False)), "not a capture file"))


RANGES = "session_id long, path string, size long, lo long, hi long, start long, packets long, until long, learned string, problem string"
PLANNED = "session_id long, path string, size long, hi long, start long, before long, state string, problem string"


def surveyed(parts: Iterator) -> Iterator:
    """Ranges (path, size, lo, hi) with their first guesses and walks."""
    import pandas as pd

    for part in parts:
        out = []
        for r in part.itertuples(index=False):
            found = [None, 0, None, "[]", None]
            with storage.opened(r.path) as file:
                f = Bytes(file, r.size)
                try:
                    kind = kind_of(f)
                    if kind:
                        if kind.link is not None and kind.link not in SUPPORTED:
                            raise ValueError(f"link type {kind.link} is not supported")
                        start = kind.first if r.lo == 0 else guess(f, kind, r.lo, r.hi)
                        if start is not None:
                            n, until, learned = walk(f, kind, start, r.hi, [])
                            found = [start, n, until, json.dumps(learned), None]
                    else:
                        found[2] = r.size
                except ValueError as e:
                    found[4] = str(e)
            out.append((r.session_id, r.path, r.size, r.lo, r.hi, *found))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RANGES.split(", ")]).astype({"start": "Int64", "until": "Int64"})


def joined_up(ranges):
    """The ranges of one file in order: each starts where the one before it ended, or is walked again from there."""
    import pandas as pd

    at, before, state, out, problem = None, 0, [], [], None
    for r in ranges.sort_values("lo").itertuples(index=False):
        problem = problem or (r.problem if isinstance(r.problem, str) else None)
        start, n, until, learned = r.start, r.packets, r.until, json.loads(r.learned)
        if at is not None:
            if at >= r.hi:
                start, n, until, learned = at, 0, at, []
            elif pd.isna(start) or int(start) != at:
                with storage.opened(r.path) as file:
                    f = Bytes(file, r.size)
                    n, until, learned = walk(f, kind_of(f), at, r.hi, state)
                start = at
        if problem or pd.isna(until):
            break
        for x in learned:
            if len(x) == 2 and x[0] not in SUPPORTED:
                problem = f"link type {x[0]} is not supported"
        if n:
            out.append((r.session_id, r.path, r.size, r.hi, int(start), before, json.dumps(state), None))
        at, before, state = int(until), before + int(n), inherited(state + learned)
    if problem:
        first = ranges.iloc[0]
        out = [(first.session_id, first.path, first["size"], 0, 0, 0, "[]", problem)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in PLANNED.split(", ")])


def plan_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The ranges of all files under a path that hold packets, with the number of packets before each; one row with the
    problem for a file that is refused.  Written once, as both the packets and the refusals come from it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select(F.xxhash64("path").alias("session_id"), "path", "size", lo.alias("lo")).withColumn("hi", F.least(F.col("lo") + range_bytes, F.col("size")))
    spread = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "lo")
    return storage.stored(spread.mapInPandas(surveyed, RANGES).groupBy("path").applyInPandas(joined_up, PLANNED), "capture-ranges")


class CaptureSource(DataSource):
    """``spark.read.format("capture")``: the packets of planned ranges, a partition for each range.  The option ``plan`` is
    the folder of a table made by ``plan_ranges``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options["plan"])


MOST_TASKS = 1_000


class Ranges(InputPartition):
    def __init__(self, rows: list[dict]) -> None:
        self.rows = rows


class CaptureReader(DataSourceReader):
    def __init__(self, plan: str) -> None:
        self.plan = plan

    def partitions(self) -> list[Ranges]:
        """A partition for each range; where there are more ranges than tasks are worth, each takes as many more."""
        rows = [r for r in storage.rows(self.plan) if r["problem"] is None]
        each = -(-len(rows) // MOST_TASKS) or 1
        return [Ranges(rows[i : i + each]) for i in range(0, len(rows), each)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator:
        import pyarrow as pa

        for r in partition.rows:
            with storage.opened(r["path"]) as file:
                f, out, held = Bytes(file, r["size"]), [], 0
                for n, (frame, ts, link, wire) in packets_of(f, kind_of(f), r["start"], r["hi"], json.loads(r["state"])):
                    d = decode(frame, link)
                    if d:
                        src, dst, proto, sport, dport, flags, length, seq, data = d
                        out.append((r["session_id"], r["before"] + n, ts, src, dst, proto, sport, dport, flags, wire, length, seq, data))
                        held += len(data)
                    if len(out) >= 20_000 or held > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW(), strict=True)], names=COLUMNS)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW(), strict=True)], names=COLUMNS)


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def ARROW() -> list:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return [kinds[c.split()[1]] for c in SCHEMA.split(", ")]


def refusals(spark: SparkSession, path: str, plan: DataFrame | None = None) -> DataFrame:
    """session_id, path and reason of each file that is not read."""
    plan = plan_ranges(spark, path) if plan is None else plan
    return plan.where("problem IS NOT NULL").select("session_id", "path", F.col("problem").alias("reason"))


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE, plan: DataFrame | None = None) -> DataFrame:
    """Packet rows of all captures under a path but those refused.  A session is a file: its id is a hash of the path."""
    plan = plan_ranges(spark, path, range_bytes) if plan is None else plan
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("plan", storage.folder_of(plan)).load()


# ---- writing -----------------------------------------------------------------------------------------------------------


def ip_packet(src: str, dst: str, proto: str, sport: int, dport: int, flags: int, seq: int, data: bytes) -> bytes:
    """The IP packet of a row; of a protocol without ports, ICMP's type and code come from dport as they do on reading."""
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if proto == "TCP":
        number, body = 6, struct.pack("!HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 0x50, flags & 255, 65535, 0, 0) + data
    elif proto == "UDP":
        number, body = 17, struct.pack("!HHHH", sport, dport, (8 + len(data)) & 0xFFFF, 0) + data
    elif proto == "ICMP":
        number, body = (1 if a.version == 4 else 58), struct.pack("!BBHI", dport >> 8 & 255, dport & 255, 0, 0) + data
    else:
        number, body = 253, data
    if a.version == 4:
        return struct.pack("!BBHHHBBH", 0x45, 0, (20 + len(body)) & 0xFFFF, 0, 0, 64, number, 0) + a.packed + b.packed + body
    return struct.pack("!IHBB", 6 << 28, len(body) & 0xFFFF, number, 64) + a.packed + b.packed + body


def write_captures(packets: DataFrame, root: str) -> DataFrame:
    """Write packet rows (those of SCHEMA but session_id, with ``capture``: the file's name) as pcap files of raw IP packets.

    A capture is one task's work, in the order of packet_no.  It is written under a name of its own and then renamed, so a
    task that runs again replaces it whole.  Gives capture and packets."""

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        at, base = storage.store(root)
        at.create_dir(base, recursive=True)
        name, n, out, temporary, done = None, 0, None, None, []

        def finish():
            if out is not None:
                out.close()
                at.move(temporary, f"{base}/{name}.pcap")
                done.append((name, n))

        for part in parts:
            for r in part.itertuples(index=False):
                if r.capture != name:
                    finish()
                    name, n, temporary = r.capture, 0, f"{base}/.{r.capture}-{uuid.uuid4().hex}"
                    out = at.open_output_stream(temporary, compression=None)
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, RAW[1]))
                frame = ip_packet(r.src, r.dst, r.proto, int(r.sport), int(r.dport), int(r.tcp_flags), int(r.seq), bytes(r.payload))
                micros = round(r.ts * 1e6)
                out.write(struct.pack("<4I", micros // 10**6, micros % 10**6, len(frame), len(frame)) + frame)
                n += 1
        finish()
        yield pd.DataFrame(done, columns=["capture", "packets"])

    rows = packets.select("capture", "packet_no", "ts", "src", "dst", "proto", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sport", "dport", "tcp_flags", "seq")], F.coalesce("payload", F.lit(b"")).alias("payload"))
    return storage.stored(rows.repartition("capture").sortWithinPartitions("capture", "packet_no").mapInPandas(run, "capture string, packets long"), "captures-written")
