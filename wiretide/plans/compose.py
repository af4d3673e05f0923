"""Small packages for queries and tests: archives, native libraries and binary manifests, sound or forged in one place."""

from __future__ import annotations

import struct
import zlib

from ..sources import binary_xml


def archive(entries: list[tuple], before: bytes = b"", comment: bytes = b"") -> bytes:
    """entries: (name, data, method, {field: central value}, {field: local value}); fields: name, method, flags, crc, packed, size, start."""
    out, directory = before, b""
    for name, data, method, *forged in entries:
        packed = data
        if method == 8:
            deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = deflate.compress(data) + deflate.flush()
        true = {"name": name, "method": method, "flags": 0x800, "crc": zlib.crc32(data), "packed": len(packed), "size": len(data), "start": len(out) - len(before)}
        c, x = (true | f for f in (forged + [{}, {}])[:2])
        label, own = c["name"].encode(), x["name"].encode()
        directory += struct.pack("<4s6H3I5HII", b"PK\x01\x02", 20, 20, c["flags"], c["method"], 0, 0, c["crc"], c["packed"], c["size"], len(label), 0, 0, 0, 0, 0, c["start"]) + label
        out += struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, x["flags"], x["method"], 0, 0, x["crc"], x["packed"], x["size"], len(own), 0) + own + packed
    return out + directory + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, len(entries), len(entries), len(directory), len(out) - len(before), len(comment)) + comment


def library(imports: list[str], exports: list[str] = (), needed: list[str] = (), bits: int = 64, order: str = "<", machine: int = 0xB7, more: bytes = b"") -> bytes:
    """An ELF file with a dynamic string, symbol and link table."""
    names, at = b"\0", {}
    for n in (*imports, *exports, *needed):
        at[n] = len(names)
        names += n.encode() + b"\0"
    wide = bits == 64
    symbol = (lambda n, where: struct.pack(order + "IBBHQQ", n, 0, 0, where, 0, 0)) if wide else (lambda n, where: struct.pack(order + "IIIBBH", n, 0, 0, 0, 0, where))
    symbols = symbol(0, 0) + b"".join(symbol(at[n], 0) for n in imports) + b"".join(symbol(at[n], 1) for n in exports)
    links = b"".join(struct.pack(order + ("QQ" if wide else "II"), 1, at[n]) for n in needed) + bytes(16 if wide else 8)
    head = 64 if wide else 52
    body, places = b"", []
    for part in (names, symbols, links, more):
        places.append((head + len(body), len(part)))
        body += part
    table = head + len(body)
    section = (lambda kind, place, link: struct.pack(order + "IIQQQQIIQQ", 0, kind, 0, 0, *place, link, 0, 0, 0)) if wide else (lambda kind, place, link: struct.pack(order + "10I", 0, kind, 0, 0, *place, link, 0, 0, 0))
    sections = section(0, (0, 0), 0) + section(3, places[0], 0) + section(11, places[1], 1) + section(6, places[2], 1)
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2, 1]) + bytes(9)
    header = ident + struct.pack(order + "HHI" + ("QQQ" if wide else "III") + "IHHHHHH", 3, machine, 1, 0, 0, table, 0, head, 0, 0, 64 if wide else 40, 4, 0)
    return header + body + sections


RESOURCE = {name: number for number, name in binary_xml.ATTRIBUTES.items()}


def manifest(elements: list[tuple], forged: str = "", utf8: bool = False) -> bytes:
    """elements: (tag, {attribute: text or number}, children); forged: the indicator that the bytes will show."""
    words: list[str] = [*RESOURCE]

    def place(word: str) -> int:
        if word not in words:
            words.append(word)
        return words.index(word)

    def chunk(kind: int, body: bytes, head: int = 16) -> bytes:
        return struct.pack("<HHI", kind, head, 8 + len(body)) + body

    def element(tag: str, attributes: dict, children: list) -> bytes:
        raw = b""
        for name, value in attributes.items():
            key = place(name)
            if isinstance(value, str):
                raw += struct.pack("<IIIHBBI", 0xFFFFFFFF, key, place(value), 8, 0, 3, place(value))
            else:
                raw += struct.pack("<IIIHBBI", 0xFFFFFFFF, key, 0xFFFFFFFF, 8, 0, 0x10, value)
        first, each = 20 if forged != "axml.attribute_start" or tag != "manifest" else 24, 20 if forged != "axml.attribute_size" or tag != "manifest" else 28
        start = chunk(0x102, struct.pack("<IIIIHHHHHH", 1, 0xFFFFFFFF, 0xFFFFFFFF, place(tag), first, each, len(attributes), 0, 0, 0) + raw)
        return start + b"".join(element(*c) for c in children) + chunk(0x103, struct.pack("<IIII", 1, 0xFFFFFFFF, 0xFFFFFFFF, place(tag)))

    tree = b"".join(element(*e) for e in elements)
    extra = {"axml.junk_between_elements": b"\xff" * 12, "axml.unknown_chunk": chunk(0x199, bytes(8)), "axml.zero_size_namespace_end": struct.pack("<HHI", 0x101, 0, 0) + bytes(16)}.get(forged, b"")
    shown = ["" if forged == "axml.attribute_names" and w == "name" else w for w in words]
    texts, offsets = b"", []
    for w in shown:
        offsets.append(len(texts))
        raw = w.encode() if utf8 else w.encode("utf-16-le")
        texts += bytes([len(w), len(raw)]) + raw + b"\0" if utf8 else struct.pack("<H", len(w)) + raw + b"\0\0"
    texts += bytes(-len(texts) % 4)
    count = len(shown) + 5 * (forged == "axml.string_count_mismatch")
    pool = chunk(1, struct.pack("<5I", count, 0, 0x100 * utf8, 28 + 4 * len(shown), 0) + struct.pack(f"<{len(shown)}I", *offsets) + texts, 28)
    resources = chunk(0x180, struct.pack(f"<{len(RESOURCE)}I", *RESOURCE.values()), 8)
    body = pool + resources + extra + tree
    return struct.pack("<HHI", 3 if forged != "axml.bad_magic" else 8, 8, 8 + len(body)) + body
