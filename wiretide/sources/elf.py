"""Native libraries: what an ELF file's tables say, as far as they can be read.

A header that contradicts itself or tables beyond the file's end make a library *broken*, which is a finding; if only a part
of the file was read, it is not examined instead."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Layouts by class (header from byte 24, section, symbol, dynamic entry) and numbers of the format.
MAGIC = b"\x7fELF"
LAYOUTS = {1: ("3I I 6H", "10I", "3I 2B H", "2I"), 2: ("3Q I 6H", "2I 4Q 2I 2Q", "I 2B H 2Q", "2Q")}
MACHINES = {0x03: "x86", 0x28: "arm", 0x3E: "x86_64", 0xB7: "arm64", 0x08: "mips", 0xF3: "riscv"}
DYNAMIC_SYMBOLS, DYNAMIC, NEEDED = 11, 6, 1
# Strings that tell something wherever they stand in a library.
TELLING = (
    "/proc/self/maps", "/proc/version", "/system/bin/su", "/system/xbin/su", "magisk", "Magisk", "supersu", "SuperSU", "frida", "xposed", "Xposed", "substrate",
    "ro.kernel.qemu", "goldfish", "ranchu", "RegisterNatives",
)
#: Bounds on what a file may claim.
SECTIONS, SYMBOLS, ENTRIES, NAME = 512, 20_000, 512, 256


@dataclass
class Library:
    broken: str | None = None
    reason: str = ""
    machine: str | None = None
    bits: int | None = None
    needed: set[str] = field(default_factory=set)
    imports: set[str] = field(default_factory=set)
    exports: set[str] = field(default_factory=set)


@dataclass
class Section:
    kind: int
    offset: int
    size: int
    link: int
    each: int


class Reader:
    """Records of a file in its byte order; None beyond its end."""

    def __init__(self, data: bytes, order: str) -> None:
        self.data, self.order = data, order

    def record(self, layout: str, at: int) -> tuple | None:
        s = struct.Struct(self.order + layout.replace(" ", ""))
        return s.unpack_from(self.data, at) if 0 <= at <= len(self.data) - s.size else None

    def records(self, layout: str, section: Section, each: int, most: int):
        """The records of a section, up to the file's end."""
        for i in range(min(section.size // each, most)):
            r = self.record(layout, section.offset + i * each)
            if r is None:
                return
            yield r

    def name(self, table: Section, at: int) -> str:
        start = table.offset + at
        end = self.data.find(b"\0", start, start + NAME)
        return self.data[start:end].decode("utf-8", "replace") if 0 <= start < end else ""


def read(data: bytes, partial: bool = False) -> Library:
    out = Library()
    try:
        survey(data, out)
    except ValueError as e:
        out.reason = f"only {len(data)} bytes were read: {e}" if partial else str(e)
        out.broken = None if partial else str(e)
    return out


def survey(data: bytes, out: Library) -> None:
    if len(data) < 64 or data[:4] != MAGIC:
        raise ValueError("shorter than a header")
    if data[4] not in LAYOUTS or data[5] not in (1, 2):
        raise ValueError("no such class or byte order")
    header, section, symbol, dynamic = LAYOUTS[data[4]]
    out.bits, f = 32 * data[4], Reader(data, "<" if data[5] == 1 else ">")
    machine = f.record("H", 18)[0]
    out.machine = MACHINES.get(machine, f"machine {machine}")
    _, _, at, _, _, _, _, each, count, _ = f.record(header, 24)
    if not at or not count:
        out.reason = "no section table"
        return
    sections = []
    for i in range(min(count, SECTIONS)):
        r = f.record(section, at + i * each)
        if r is None:
            raise ValueError(f"section {i} is beyond the end of the file")
        sections.append(Section(r[1], r[4], r[5], r[6], r[9]))
    linked = lambda s: sections[s.link] if s.link < len(sections) else None
    size = 24 if out.bits == 64 else 16
    for s in sections:
        strings = linked(s)
        if strings is None:
            continue
        if s.kind == DYNAMIC_SYMBOLS:
            for r in f.records(symbol, s, s.each or size, SYMBOLS):
                name = f.name(strings, r[0])
                if name:
                    (out.exports if r[3 if out.bits == 64 else 5] else out.imports).add(name)
        elif s.kind == DYNAMIC:
            for tag, value in f.records(dynamic, s, out.bits // 4, ENTRIES):
                if not tag:
                    break
                if tag == NEEDED and (name := f.name(strings, value)):
                    out.needed.add(name)


def telling(data: bytes) -> list[str]:
    return sorted(t for t in TELLING if t.encode() in data)
