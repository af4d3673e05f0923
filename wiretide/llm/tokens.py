"""Byte-level BPE ids of whole texts, and token counts attributed to sections through offsets.

Ids are those of the ``tokenizers`` library for the given JSON file without special tokens added.  Ordinary texts go
through the faster rank encoder of the same vocabulary, which gives the same ids; a text that holds the special token's
own string, an unusual character (where the two libraries' character tables may differ) or a very long run without a
break goes through ``tokenizers`` itself.  Where no two white space characters meet, the rank encoder splits by a pattern
without the lookahead that only runs of white space need, which takes half the time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame

from .common import pick

#: Characters for which both libraries' patterns are known to agree; anything else takes the slow way.
PLAIN = r"[^\t\n\r -~¡-ɏ‐-›€]"
LONG_RUN = r"[^\s]{3000}"
#: How the pattern ends, and what it may end with where white space comes singly.
RUNS, SINGLE = r"\s+(?!\S)|\s+", r"\s"


class Encoder:
    """Made where a task runs, from the vocabulary files there."""

    def __init__(self, json_file: str, rank_file: str, pattern: str) -> None:
        import base64
        import re

        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_file)
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.single = self.fast
        if pattern.endswith(RUNS):
            self.single = tiktoken.Encoding("single", pat_str=pattern.removesuffix(RUNS) + SINGLE, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        self.plain, self.long, self.space, self.spaces = map(re.compile, (PLAIN, LONG_RUN, r"\s", r"\s\s"))
        self.width = np.zeros(self.slow.get_vocab_size(), dtype=np.int64)
        for b, i in ranks.items():
            self.width[i] = len(b)
        for t, i in self.slow.get_vocab().items():
            if not self.width[i]:  # a special token: its own string
                self.width[i] = len(t.encode())

    def odd(self, text: str) -> bool:
        """Whether a text takes the slow way.  A very long run covers a thousand characters from some multiple of it on."""
        if self.plain.search(text) or any(s in text for s in self.special):
            return True
        return any(not self.space.search(text, k, k + 1000) for k in range(0, len(text) - 999, 1000)) and bool(self.long.search(text))

    def ids(self, text: str):
        import numpy as np

        if self.odd(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return (self.fast if self.spaces.search(text) else self.single).encode_to_numpy(text, disallowed_special=())


@cache
def encoder(json_file: str, rank_file: str, pattern: str) -> Encoder:
    """One for each worker, which its tasks share."""
    return Encoder(json_file, rank_file, pattern)


def public_files() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def pieces(docs: DataFrame, capacity: int, end_id: int, files: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and one end id, cut only where longer than capacity."""
    files = files or public_files()

    def encode(batches: Iterator) -> Iterator:
        import os
        import zlib

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(*files)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, "doc_id", "text").mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def section_counts(docs: DataFrame, rule: str = "start", files: tuple[str, str, str] | None = None) -> DataFrame:
    """Token counts of each section (a line of the text, with its line end), from one encoding of the whole text.

    doc_id, section int (from 0), start and end long (code points), n_tokens long, n_crossing long (tokens counted here
    that reach into a later section).  A token that crosses a boundary goes to the section of its first byte (rule
    "start"), or to the section with most of its bytes, the earlier on ties ("most").  A null or empty text has one
    empty section without tokens.  Counts over a document always sum to the tokens of its whole text.
    """
    if rule not in ("start", "most"):
        raise ValueError(rule)
    files = files or public_files()

    def count(batches: Iterator) -> Iterator:
        import os

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(*files)
        for batch in batches:
            got: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                edges = np.concatenate([[0], np.flatnonzero(raw == 10) + 1, [len(raw)]])
                if len(edges) > 2 and edges[-1] == edges[-2]:
                    edges = edges[:-1]  # a final line end opens no section
                ends = np.cumsum(enc.width[enc.ids(text)])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                a = np.searchsorted(edges[1:-1], starts, side="right")
                b = np.searchsorted(edges[1:-1], ends - 1, side="right")
                crosses, at = b > a, a
                if rule == "most" and crosses.any():
                    at = a.copy()
                    for i in np.flatnonzero(crosses):
                        k = np.arange(a[i], b[i] + 1)
                        at[i] = k[np.argmax(np.minimum(ends[i], edges[k + 1]) - np.maximum(starts[i], edges[k]))]
                n = len(edges) - 1
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[edges]
                for to, values in zip(got, ([doc] * n, range(n), points[:-1], points[1:], np.bincount(at, minlength=n), np.bincount(at[crosses], minlength=n)), strict=True):
                    to.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds, strict=True)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return pick(docs, "doc_id", "text").mapInArrow(count, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")
