"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut before each space that follows another character (no piece of the model crosses such a place;
the model is checked for that), and each distinct chunk is encoded once.  The concatenated chunks are indexed by a suffix
array, sorted as deep as the longest piece; every piece finds its range of occurrences by binary search; the occurrences,
put in order of position, are the edges of a lattice.

The given model is of the BPE kind, whose segmentation is not the best path by score.  Relaxing therefore follows BPE's
order: among neighbouring symbols whose union is an edge, the one with the best score (the leftmost on ties) is joined,
for all chunks at once, until no union is an edge.  Characters that are no edge become byte pieces.

Cases: null or empty text has no ids.  The word-boundary mark in a text is read as a space, as the model does.  Repeated
texts give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import pick

MARK = "▁"
SLICE_CHARS = 600_000
LONG_CHUNK = 400


class Model:
    """Pieces, ranks and byte ids of a SentencePiece file, with the pieces packed for searching."""

    def __init__(self, path: str) -> None:
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.byte = np.zeros(256, dtype=np.int64)
        self.raw: list[bytes] = [b""] * len(self.texts)
        normal = []
        for i, t in enumerate(self.texts):
            if sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
                self.raw[i] = bytes([int(t[3:5], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                normal.append(i)
                self.raw[i] = t.replace(MARK, " ").encode()
        if any(MARK in t.lstrip(MARK) for t in map(self.texts.__getitem__, normal)):
            raise ValueError("a piece of this model crosses a word boundary")
        self.ids = np.array(normal)
        self.lens = np.array([len(self.texts[i]) for i in normal])
        self.deep = int(self.lens.max())
        self.words = -(-self.deep // 3)  # three code points of 21 bits in each word
        points = np.zeros((len(normal), self.words * 3), dtype=np.uint64)
        for k, i in enumerate(normal):
            points[k, : self.lens[k]] = [ord(c) for c in self.texts[i]]
        self.low = self.pack(points)
        points[points == 0] = 0x1FFFFF
        for k, n in enumerate(self.lens):
            points[k, n:] = 0x1FFFFF
        self.high = self.pack(points)
        order = np.argsort([sp.get_score(int(i)) for i in normal], kind="stable")[::-1]
        self.rank = np.full(len(self.texts), np.iinfo(np.int64).max, dtype=np.int64)
        scores = np.array([sp.get_score(int(i)) for i in normal])[order]
        self.rank[self.ids[order]] = np.cumsum(np.concatenate([[0], scores[1:] != scores[:-1]]))

    @staticmethod
    def pack(points):
        import numpy as np

        a = points.reshape(len(points), -1, 3).astype(np.uint64)
        return (a[:, :, 0] << np.uint64(42)) | (a[:, :, 1] << np.uint64(21)) | a[:, :, 2]

    def edges(self, points):
        """For each position and length the piece there, or -1.  points: code points, with 0 after each chunk."""
        import numpy as np

        n = len(points)
        padded = np.concatenate([points, np.zeros(self.words * 3, dtype=points.dtype)]).astype(np.uint64)
        # Nothing after a chunk's end takes part: the end is 0, and pieces hold no 0.
        keys = [(padded[3 * w : n + 3 * w] << np.uint64(42)) | (padded[3 * w + 1 : n + 3 * w + 1] << np.uint64(21)) | padded[3 * w + 2 : n + 3 * w + 2] for w in range(self.words)]
        array = np.lexsort(keys[::-1])
        keys = [k[array] for k in keys]
        first = self.search(keys, self.low, False)
        last = self.search(keys, self.high, True)
        count = last - first
        found = np.repeat(np.arange(len(self.ids)), count)
        at = array[np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        order = np.argsort(at, kind="stable")
        found, at = found[order], at[order]
        table = np.full((n, self.deep), -1, dtype=np.int32)
        table[at, self.lens[found] - 1] = self.ids[found]
        return table

    @staticmethod
    def search(keys, wanted, right: bool):
        """Binary search of many keys of several words at once."""
        import numpy as np

        lo = np.zeros(len(wanted), dtype=np.int64)
        hi = np.full(len(wanted), len(keys[0]), dtype=np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            m = np.minimum(mid, len(keys[0]) - 1)
            less = np.zeros(len(wanted), dtype=bool)
            equal = np.ones(len(wanted), dtype=bool)
            for w, k in enumerate(keys):
                v = k[m]
                less |= equal & (v < wanted[:, w])
                equal &= v == wanted[:, w]
            go = (less | (equal & right)) & (lo < hi)
            lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
        return lo

    def encode_chunks(self, chunks: list[str]):
        """(ids of all chunks in order, number of ids of each)."""
        import numpy as np

        if not chunks:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        parts, lens, batch, size = [], [], [], 0
        for c in chunks:
            batch.append(c)
            size += len(c)
            if size >= SLICE_CHARS:
                got = self.slice(batch)
                parts.append(got[0])
                lens.append(got[1])
                batch, size = [], 0
        if batch:
            got = self.slice(batch)
            parts.append(got[0])
            lens.append(got[1])
        return np.concatenate(parts), np.concatenate(lens)

    def slice(self, chunks: list[str]):
        import numpy as np

        text = "\0".join(chunks) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.array([len(c) for c in chunks])
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        table = self.edges(points)
        # One symbol for each character; owner: its chunk.
        owner = np.repeat(np.arange(len(chunks)), size)
        start = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        width = np.ones(len(start), dtype=np.int64)
        long = size > LONG_CHUNK
        done = [(start[long[owner]], width[long[owner]], owner[long[owner]])]
        if long.any():
            done = [self.one_by_one(table, begin[c], size[c], c) for c in np.flatnonzero(long)]
        else:
            done = []
        live = ~long[owner]
        start, width, owner = start[live], width[live], owner[live]
        far = np.iinfo(np.int64).max
        while len(start):
            both = width[:-1] + width[1:]
            ok = (owner[:-1] == owner[1:]) & (both <= self.deep)
            piece = table[start[:-1], np.minimum(both, self.deep) - 1]
            rank = np.where(ok & (piece >= 0), self.rank[piece], far)
            rank = np.append(rank, far)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, first)
            per = np.diff(np.append(first, len(start)))
            over = np.repeat(best == far, per)
            done.append((start[over], width[over], owner[over]))
            hit = np.flatnonzero((rank == np.repeat(best, per)) & (rank != far))
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])] if len(hit) else hit
            width[hit] += width[hit + 1]
            keep = ~over
            keep[hit + 1] = False
            start, width, owner = start[keep], width[keep], owner[keep]
        start, width, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start, kind="stable")
        start, width, owner = start[order], width[order], owner[order]
        ids = table[start, width - 1].astype(np.int64)
        lost = np.flatnonzero(ids < 0)
        times = np.ones(len(ids), dtype=np.int64)
        if len(lost):  # characters without a piece: their bytes
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[start[lost]]]
            times[lost] = [len(r) for r in raw]
            out = np.repeat(ids, times)
            out[np.repeat(ids < 0, times)] = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            ids = out
        return ids.astype(np.uint32), np.bincount(owner, weights=times, minlength=len(chunks)).astype(np.int64)

    def one_by_one(self, table, begin: int, size: int, chunk: int):
        """The same joining with a heap, for chunks so long that a pass for each join is too slow."""
        import heapq

        import numpy as np

        width = [1] * size
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < size and width[a] + width[b] <= self.deep:
                p = table[begin + a, width[a] + width[b] - 1]
                if p >= 0:
                    heapq.heappush(heap, (int(self.rank[p]), a, width[a] + width[b]))

        for a in range(size):
            offer(a)
        while heap:
            _, a, w = heapq.heappop(heap)
            b = after[a]
            if not width[a] or b >= size or width[a] + width[b] != w:
                continue
            width[a], width[b] = w, 0
            after[a] = after[b]
            if after[b] < size:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        at = np.flatnonzero(width)
        return begin + at, np.array(width)[at], np.full(len(at), chunk)

    def decode(self, ids) -> str:
        """The text of ids: bytes are put together, marks become spaces, and the first one, which encoding adds, goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Chunks(dict):
    """Numbers chunks in order of first sight."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def cut(text: str) -> list[str]:
    """Chunks of a text, each but the last without its closing space: their texts are the mark and the chunk."""
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for w in words[:-1]:
        if w:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    out.append(" " * spaces + words[-1])
    return out


def encode_texts(model: Model, texts: list[str | None]):
    """For each text its ids."""
    import numpy as np

    known = Chunks()
    numbered = [np.fromiter(map(known.__getitem__, cut(t)), dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
    ids, lens = model.encode_chunks([MARK + c.replace(" ", MARK) for c in known])
    ends = np.cumsum(lens)
    for x in numbered:
        n = lens[x]
        total = int(n.sum())
        at = np.repeat(ends[x] - np.cumsum(n), n) + np.arange(total)
        yield ids[at]


def public_model() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    return _over(docs, path, lambda model, text, ids: (ids.astype("int32"),), "ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    path = path or public_model()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Model(path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip: decoding gives the text back."""
    import zlib

    def row(model, text, ids):
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), model.decode(ids.tolist()) == text

    return _over(docs, path, row, "n_ids long, ids_crc32 long, round_trip boolean")


def _over(docs: DataFrame, path: str | None, row, columns: str) -> DataFrame:
    path = path or public_model()
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [c.split()[1] for c in columns.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
        model = Model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = [row(model, t, ids) for t, ids in zip(texts, encode_texts(model, texts), strict=True)]
            cols = [pa.array([g[i] for g in got], types[k]) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", *names])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, {columns}")
