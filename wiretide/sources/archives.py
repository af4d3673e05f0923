"""Packages (ZIP archives) to rows: both header sets of every entry, native libraries, manifests.

A package is opened in place (Arrow's file systems, random access): the end record, the directory, the local headers and
the entries asked for are read, never the whole file into a cell.  Nothing is trusted: sizes are bounded by the file,
inflation by a limit, and a package that cannot be read gives a row that says why; the others are read.

Cases: an archive with bytes before it (offsets then count from its own start) or after it, or a comment; a directory cut
short, which gives the entries before the cut; an entry whose local header is missing, which has a central row alone;
repeated names, which stay separate entries.  Archives split over several files are refused; an empty file is not listed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_xml, elf, storage

# Signatures and layouts of ZIP records; the extra field that tells AES encryption.
END, CENTRAL, LOCAL, END64, LOCATOR = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04", b"PK\x06\x06", b"PK\x06\x07"
CENTRAL_LAYOUT, LOCAL_LAYOUT = "<4s6H3I5H2I", "<4s5H3I2H"
AES_EXTRA, WIDE_EXTRA, NONE32 = 0x9901, 1, 0xFFFFFFFF
STORED, DEFLATED = 0, 8
#: Bytes of a directory, of a manifest; entries, bytes of one and bytes of all native libraries that are read in a package.
DIRECTORY, MANIFEST_BYTES = 256 << 20, 32 << 20
ELF_ENTRIES, ELF_BYTES, ELF_TOTAL = 64, 16 << 20, 64 << 20
MANIFEST = "AndroidManifest.xml"
HEADERS = "sample_id long, path string, entry_no int, side string, name string, method int, flags int, crc long, size long, packed long, `start` long, `end` long, encryption string, problem string"
LIBRARIES = "sample_id long, library string, partial boolean, broken string, machine string, bits int, needed array<string>, imports array<string>, exports array<string>, telling array<string>, truncated boolean"
MANIFESTS = "sample_id long, package string, version_code long, min_sdk int, target_sdk int, permissions array<string>, components array<struct<kind:string,name:string,permission:string,actions:array<string>>>, indicators array<struct<indicator:string,entries:int,example:string>>, problem string"


@dataclass
class Entry:
    """The central header of an entry, and what its local one says (None where there is none)."""

    number: int
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    start: int
    encryption: str
    local: tuple | None = None  # name, method, flags, crc, packed, size
    data: int = 0
    end: int = 0


def extras(raw: bytes) -> dict[int, bytes]:
    """Extra fields by number, as far as they go."""
    out, at = {}, 0
    while at + 4 <= len(raw):
        kind, n = struct.unpack_from("<HH", raw, at)
        out[kind] = raw[at + 4 : at + 4 + n]
        at += 4 + n
    return out


class Archive:
    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self.entries = list(self.directory())

    def at(self, place: int, n: int) -> bytes:
        if not 0 <= place < self.size:
            return b""
        self.file.seek(place)
        return self.file.read(min(n, self.size - place))

    def directory(self) -> Iterator[Entry]:
        tail = min(self.size, 22 + 65535)
        block = self.at(self.size - tail, tail)
        at = block.rfind(END)
        while at >= 0 and at + 22 > len(block):
            at = block.rfind(END, 0, at)
        if at < 0:
            raise ValueError("not an archive: it has no end record")
        disk, first, _, count, size, offset, _ = struct.unpack_from("<4H2IH", block, at + 4)
        end = self.size - tail + at
        if count == 0xFFFF or NONE32 in (size, offset):
            place = self.at(end - 20, 20)
            if place[:4] == LOCATOR:
                wide = self.at(struct.unpack_from("<Q", place, 8)[0], 56)
                if len(wide) == 56 and wide[:4] == END64:
                    count, size, offset = struct.unpack_from("<3Q", wide, 32)
                    end -= 76
        if disk or first:
            raise ValueError("a part of an archive of several files")
        self.before = max(0, end - size - offset)  # bytes in front of the archive
        raw = self.at(self.before + offset, min(size, DIRECTORY))
        place, number = 0, 0
        while place + 46 <= len(raw) and raw[place : place + 4] == CENTRAL:
            _, _, _, flags, method, _, _, crc, packed, real, n, m, k, _, _, _, start = struct.unpack_from(CENTRAL_LAYOUT, raw, place)
            name, more = raw[place + 46 : place + 46 + n], extras(raw[place + 46 + n : place + 46 + n + m])
            wide = more.get(WIDE_EXTRA, b"")
            values = [struct.unpack_from("<Q", wide, 8 * i)[0] for i in range(len(wide) // 8)]
            real, packed, start = (values.pop(0) if x == NONE32 and values else x for x in (real, packed, start))
            entry = Entry(number, text(name, flags), method, flags, crc, packed, real, self.before + start, "none" if not flags & 1 else "aes" if AES_EXTRA in more else "zipcrypto")
            self.look(entry)
            yield entry
            place, number = place + 46 + n + m + k, number + 1

    def look(self, entry: Entry) -> None:
        """Fill in what the local header says."""
        raw = self.at(entry.start, 30)
        if len(raw) == 30 and raw[:4] == LOCAL:
            _, _, flags, method, _, _, crc, packed, size, n, m = struct.unpack(LOCAL_LAYOUT, raw)
            entry.local = (text(self.at(entry.start + 30, n), flags), method, flags, crc, packed, size)
            entry.data = entry.start + 30 + n + m
            entry.end = entry.data + entry.packed

    def content(self, entry: Entry, most: int) -> bytes:
        """At most so many bytes of an entry, unpacked.  The encryption flag is ignored, as installers do; a method that is
        neither of the two that installers know is read as they read it, as stored."""
        if entry.local is None:
            return b""
        if entry.method != DEFLATED:
            return self.at(entry.data, min(most, max(entry.packed, entry.size if entry.method != STORED else 0)))
        out, unpacker, place = b"", zlib.decompressobj(-15), entry.data
        while place < entry.data + entry.packed and len(out) < most and not unpacker.eof:
            block = self.at(place, min(1 << 16, entry.data + entry.packed - place))
            if not block:
                break
            try:
                out += unpacker.decompress(unpacker.unconsumed_tail + block, most - len(out))
            except zlib.error:
                break
            place += len(block)
        while unpacker.unconsumed_tail and len(out) < most:
            try:
                out += unpacker.decompress(unpacker.unconsumed_tail, most - len(out))
            except zlib.error:
                break
        return out


def text(raw: bytes, flags: int) -> str:
    return raw.decode("utf-8" if flags & 0x800 or raw.isascii() else "cp437", "replace")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, path and size of the files under a path, listed by Spark and dealt evenly."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.xxhash64("path").alias("sample_id"), "path", F.col("length").alias("size"))
    return files.repartition(spark.sparkContext.defaultParallelism * 4, "path")


def each_archive(part) -> Iterator:
    """(row, archive or None, problem) of each file of a batch."""
    for r in part.itertuples(index=False):
        with storage.opened(r.path) as file:
            try:
                yield r, Archive(file, r.size), None
            except (ValueError, struct.error) as e:
                yield r, None, str(e)


def _frame(rows: list[tuple], kind: str):
    import pandas as pd

    names = [c.split()[0].strip("`") for c in kind.split(", ")] if "<" not in kind else [c[0] for c in columns(kind)]
    return pd.DataFrame(rows, columns=names, dtype=object)


def columns(kind: str) -> list[tuple[str, str]]:
    """Names and types of a schema text whose types may hold commas."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(kind + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, what = kind[last:i].strip().partition(" ")
            out.append((name.strip("`"), what))
            last = i + 1
    return out


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each header of each entry (central, and local where there is one); one with the problem for other files."""

    def run(parts: Iterator) -> Iterator:
        for part in parts:
            out = []
            for r, archive, problem in each_archive(part):
                if archive is None:
                    out.append((r.sample_id, r.path, *[None] * 11, problem))
                    continue
                for e in archive.entries:
                    out.append((r.sample_id, r.path, e.number, "central", e.name, e.method, e.flags, e.crc, e.size, e.packed, e.start, e.end if e.local else None, e.encryption, None))
                    if e.local:
                        name, method, flags, crc, packed, size = e.local
                        out.append((r.sample_id, r.path, e.number, "local", name, method, flags, crc, size, packed, e.start, e.end, e.encryption, None))
            yield _frame(out, HEADERS)

    return _files(spark, path).mapInPandas(run, HEADERS)


def safety(headers: DataFrame, largest: int = 1 << 30) -> DataFrame:
    """sample_id, finding, entries: why a package should not be unpacked (its names alone do not stop that)."""
    from ..operators import packages

    central = headers.where("side = 'central' AND problem IS NULL")
    spans = packages.overlapping_entries(central.where("`end` IS NOT NULL").select("sample_id", "entry_no", "start", "end"))
    name = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    climbs = F.startswith(name, F.lit("/")) | (F.substring("name", 2, 1) == ":") | F.array_contains(F.split(name, "/"), "..")
    parts = [
        spans.where("overlaps").select("sample_id", F.lit("archive.overlapping_entries").alias("finding")),
        central.where(F.lower("name").endswith(".apk") & (F.col("size") > largest)).select("sample_id", F.lit("archive.declared_size_exceeds_limit").alias("finding")),
        central.where(climbs).select("sample_id", F.lit("archive.path_traversal_names").alias("finding")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("sample_id", "finding").agg(F.count("*").alias("entries"))


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each native library of each package, known by its first bytes, in the order of the directory and within
    the budget; ``truncated`` marks those of a package in which the budget ended."""

    def run(parts: Iterator) -> Iterator:
        for part in parts:
            out = []
            for r, archive, _ in each_archive(part):
                found, left, truncated = [], ELF_TOTAL, False
                for e in archive.entries if archive else ():
                    if len(found) >= ELF_ENTRIES or left <= 0:
                        truncated = True
                        break
                    if e.size < 64 or e.name.endswith("/") or archive.content(e, 4) != elf.MAGIC:
                        continue
                    data = archive.content(e, min(ELF_BYTES, left))
                    left -= len(data)
                    found.append((e.name, len(data) < e.size, data))
                for name, partial, data in found:
                    x = elf.read(data, partial)
                    out.append((r.sample_id, name, partial, x.broken, x.machine, x.bits, sorted(x.needed), sorted(x.imports), sorted(x.exports), elf.telling(data) if x.broken is None else [], truncated))
            yield _frame(out, LIBRARIES)

    return _files(spark, path).mapInPandas(run, LIBRARIES)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row for each package: what its manifest declares, and the signs of tampering in it; packages without one have the
    problem."""

    def run(parts: Iterator) -> Iterator:
        for part in parts:
            out = []
            for r, archive, problem in each_archive(part):
                entry = next((e for e in archive.entries if e.name == MANIFEST and e.local), None) if archive else None
                if entry is None:
                    out.append((r.sample_id, *[None] * 4, None, None, [], problem or "no manifest"))
                    continue
                m = binary_xml.read(archive.content(entry, MANIFEST_BYTES))
                out.append((r.sample_id, m.package, m.version_code, m.min_sdk, m.target_sdk, sorted(m.permissions), m.components, m.indicators(), m.problem))
            yield _frame(out, MANIFESTS)

    return _files(spark, path).mapInPandas(run, MANIFESTS)


HEADS = "sample_id long, entry_no int, name string, size long, head binary"


def read_heads(spark: SparkSession, path: str, least: int = 1_000_000, window: int = 1 << 16, most: int = 64) -> DataFrame:
    """The first bytes of the large entries of each package, for ``packages.opaque_entries``; libraries and code are left
    out, and no more than ``most`` entries of a package are read, however it is built."""

    def run(parts: Iterator) -> Iterator:
        for part in parts:
            out = []
            for r, archive, _ in each_archive(part):
                large = [e for e in archive.entries if e.size >= least and not e.name.startswith("lib/") and not e.name.endswith("/") and not (e.name.startswith("classes") and e.name.endswith(".dex"))] if archive else []
                out += [(r.sample_id, e.number, e.name, e.size, archive.content(e, window)) for e in large[:most]]
            yield _frame(out, HEADS)

    return _files(spark, path).mapInPandas(run, HEADS)
