"""Android's binary XML manifests: what they declare, and signs that they were made to mislead other readers.

The reader follows chunks by their sizes.  Where a chunk cannot be one, it looks for the next plausible chunk and goes on;
what it passed over is a finding, as is every field that the format fixes and this manifest does not.

Cases: an empty or very short manifest has the problem "no chunks"; strings or attributes that point outside the manifest
read as empty; resources (values that are references) read as null."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Chunk types, the attribute numbers that name what blanked attributes are, value types.
XML, STRINGS, RESOURCES, NS_START, NS_END, START, END, TEXT = 3, 1, 0x180, 0x100, 0x101, 0x102, 0x103, 0x104
KNOWN = (XML, STRINGS, RESOURCES, NS_START, NS_END, START, END, TEXT)
ATTRIBUTES = {0x01010003: "name", 0x01010006: "permission", 0x0101020C: "minSdkVersion", 0x01010270: "targetSdkVersion", 0x0101021B: "versionCode"}
ATTRIBUTE_BYTES, UTF8, STRING, NUMBERS, NOTHING = 20, 0x100, 3, (0x10, 0x11), 0xFFFFFFFF
COMPONENTS = ("activity", "activity-alias", "service", "receiver", "provider")
#: Strings and bytes passed over that a manifest may cost.
STRINGS_MOST, SKIPPED_MOST = 1 << 20, 1 << 24


@dataclass
class Manifest:
    package: str | None = None
    version_code: int | None = None
    min_sdk: int | None = None
    target_sdk: int | None = None
    permissions: set[str] = field(default_factory=set)
    components: list[tuple] = field(default_factory=list)
    found: dict[str, list[str]] = field(default_factory=dict)
    problem: str | None = None

    def note(self, indicator: str, example: str) -> None:
        self.found.setdefault(indicator, []).append(example)

    def indicators(self) -> list[tuple]:
        return [(k, len(v), v[0]) for k, v in sorted(self.found.items())]


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.out = data, Manifest()
        self.strings: list[str] = []
        self.resources: list[int] = []
        self.open: list[tuple[str, dict]] = []
        self.component: tuple | None = None

    def number(self, layout: str, at: int) -> tuple:
        size = struct.calcsize("<" + layout)
        return struct.unpack_from("<" + layout, self.data, at) if 0 <= at <= len(self.data) - size else (0,) * len(struct.unpack("<" + layout, bytes(size)))

    def run(self) -> Manifest:
        if len(self.data) < 8:
            self.out.problem = "no chunks"
            return self.out
        kind, head, _ = self.number("HHI", 0)
        if kind != XML:
            self.out.note("axml.bad_magic", f"0x{kind:04x}")
        at, skipped = head if head == 8 else 8, 0
        while at + 8 <= len(self.data):
            kind, head, size = self.number("HHI", at)
            if kind == NS_END and (head == 0 or size == 0):
                self.out.note("axml.zero_size_namespace_end", f"at {at}")
                at += size or 24
                continue
            if head < 8 or size < head or at + size > len(self.data) or size % 4:
                # No chunk: pass over what belongs to none.
                start = at
                while at + 8 <= len(self.data) and not self.plausible(at) and at - start < SKIPPED_MOST:
                    at += 4
                self.out.note("axml.junk_between_elements", f"{at - start} bytes at {start}")
                skipped += at - start
                if skipped >= SKIPPED_MOST:
                    break
                continue
            if kind == STRINGS:
                self.pool(at, head, size)
            elif kind == RESOURCES:
                self.resources = list(self.number(f"{(size - head) // 4}I", at + head))
            elif kind == START:
                self.start(at, head, size)
            elif kind == END:
                self.end()
            elif kind not in KNOWN:
                self.out.note("axml.unknown_chunk", f"0x{kind:04x} at {at}")
            at += size
        while self.open:
            self.end()
        return self.out

    def plausible(self, at: int) -> bool:
        kind, head, size = self.number("HHI", at)
        return kind in KNOWN[1:] and 8 <= head <= size and size % 4 == 0 and at + size <= len(self.data) or (kind == NS_END and (head == 0 or size == 0))

    def pool(self, at: int, head: int, size: int) -> None:
        count, styles, flags, texts, _ = self.number("5I", at + 8)
        holds = max(0, (texts - head) // 4 - styles)  # the offsets between the header and the first string
        if texts and holds != count:
            self.out.note("axml.string_count_mismatch", f"{count} declared, {holds} held")
        wide = not flags & UTF8
        for offset in self.number(f"{min(holds, (size - head) // 4, STRINGS_MOST)}I", at + head):
            self.strings.append(self.string(at + texts + offset, wide))

    def string(self, at: int, wide: bool) -> str:
        """A length of one or two units, then the text; UTF-8 has its length in characters before that in bytes."""
        try:
            if wide:
                n = self.data[at] | self.data[at + 1] << 8
                at += 2
                if n & 0x8000:
                    n = (n & 0x7FFF) << 16 | self.data[at] | self.data[at + 1] << 8
                    at += 2
                return self.data[at : at + 2 * n].decode("utf-16-le", "replace")
            for _ in range(2):
                n = self.data[at]
                at += 1
                if n & 0x80:
                    n = (n & 0x7F) << 8 | self.data[at]
                    at += 1
            return self.data[at : at + n].decode("utf-8", "replace")
        except IndexError:
            return ""

    def text(self, number: int) -> str | None:
        return self.strings[number] if number < len(self.strings) else None

    def start(self, at: int, head: int, size: int) -> None:
        _, name, first, each, count = self.number("IIHHH", at + head)
        tag, values = self.text(name) or "", {}
        if first != ATTRIBUTE_BYTES:
            self.out.note("axml.attribute_start", f"{tag}: {first}")
        if each != ATTRIBUTE_BYTES:
            self.out.note("axml.attribute_size", f"{tag}: {each}")
        for i in range(min(count, (size - head - 20) // ATTRIBUTE_BYTES)):
            _, key, raw, _, _, kind, value = self.number("IIIHBBI", at + head + 20 + i * ATTRIBUTE_BYTES)
            known = ATTRIBUTES.get(self.resources[key]) if key < len(self.resources) else None
            label = self.text(key)
            if not label:
                self.out.note("axml.attribute_names", f"{tag}: attribute {i}")
            content = self.text(value) if kind == STRING else value if kind in NUMBERS else self.text(raw) if raw != NOTHING else None
            values[known or label or ""] = content
        self.open.append((tag, values))
        self.declare(tag, values)

    def declare(self, tag: str, values: dict) -> None:
        out, name = self.out, values.get("name")
        name = name if isinstance(name, str) else None
        if tag == "manifest":
            out.package = values.get("package") if isinstance(values.get("package"), str) else out.package
            out.version_code = whole(values.get("versionCode"))
        elif tag == "uses-sdk":
            out.min_sdk, out.target_sdk = whole(values.get("minSdkVersion")), whole(values.get("targetSdkVersion"))
        elif tag in ("uses-permission", "uses-permission-sdk-23") and name:
            out.permissions.add(name)
        elif tag in COMPONENTS:
            guard = values.get("permission")
            self.component = (tag, name, guard if isinstance(guard, str) else None, [])
            out.components.append(self.component)
        elif tag == "action" and self.component and name:
            self.component[3].append(name)

    def end(self) -> None:
        if self.open and self.open.pop()[0] in COMPONENTS:
            self.component = None


def whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def read(data: bytes) -> Manifest:
    return Reader(data).run()
