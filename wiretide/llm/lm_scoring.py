"""Language-model scores from a probabilistic suffix tree over words.

A text is its lower-cased words, then one end; the end also stands before the first word.  The tree's states are contexts:
the last 0 to ``depth`` symbols.  The root's distribution is (c + 1) / (N + V + 1), which leaves one share for all words
never learned.  A longer context is a candidate where training texts have it ``least`` times for each of its symbols, an absolute
count, so that the tree grows with the corpus; it is retained where its next symbols diverge from its parent's (the context without its
oldest symbol): the sum of count * ln(share here / share in the parent) must reach ``gain`` for each symbol seen.  A
retained state discounts each of its counts by ``discount`` and gives what is left over to its parent's distribution.  A
symbol is scored by the longest retained suffix before it.

The tree is never gathered: its counts live in buckets dealt by a hash of the whole n-gram, so that a frequent context is
spread over all of them.  Texts are read once, into blocks of coded words.  In round k a block sends each of its n-grams
of length k + 1 once, with its training count, and each of its contexts of length k - 1 once, with its share of the
context's divergence and number of kinds (an occurrence counts 1 / count); buckets add up and answer in the order asked.
What a bucket or a block holds is bounded by its size, however frequent a word is.  Within its bucket a word is known by
48 bits of its hash and a longer n-gram by 40: of the million that a bucket holds about one in 100 million, and one
in a million, share the count of another.

Cases: null text is empty (its end alone).  An id is learned from or held out by its crc32; a null id is learned from.
With no training text, counts are 0 and the tree is one uniform root.  Repeated rows are counted and scored each; an
empty table gives no rows; extra columns are ignored.  One text must fit into a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, materialise, pick, sweep, written

FOLDS, HELD_OUT = 7, 2
END_HASH = 0  # stands for the end among word hashes
BLOCK_TOKENS = 400_000
KEYS_PER_BUCKET = 1_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def _batch(rows: dict, types: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in types.items()], list(types))


def width(kind: int) -> int:
    """Bytes of a key within its bucket."""
    return 6 if kind == 0 else 5


def pack(values, size: int) -> bytes:
    """Whole numbers as their ``size`` low bytes, all first bytes before all second ones, compressed: sorted or small numbers
    then take far less to shuffle and keep."""
    import numpy as np
    import zstandard

    return zstandard.compress(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].T.tobytes(), 1)


def unpack(raw: bytes, size: int):
    import numpy as np
    import zstandard

    raw = zstandard.decompress(raw)
    out = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    out[:, 8 - size :] = np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def read_blocks(rows: DataFrame) -> DataFrame:
    """block, ids, train (bytes, one a document), lens (tokens of each), words (hashes of the block's distinct words; the
    first is the end), codes (each token's number among them, packed), tokens (how many)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        kinds = {"block": pa.int64(), "ids": pa.list_(pa.int64()), **dict.fromkeys(("train", "lens", "words", "codes"), pa.binary()), "tokens": pa.int64()}
        number = TaskContext.get().partitionId() << 24

        def row(ids, train, lens, known, codes):
            hashes = np.array([END_HASH, *(xxhash.xxh3_64_intdigest(w) or 1 for w in list(known)[1:])], dtype="<u8")
            codes = np.array(codes, dtype=np.uint64)
            return _batch({"block": [number], "ids": [ids], "train": [bytes(train)], "lens": [np.array(lens, dtype="<i8").tobytes()], "words": [hashes.tobytes()], "codes": [pack(codes, 4)], "tokens": [len(codes)]}, kinds)

        fresh = lambda: ([], [], [], {b"": 0}, [])
        ids, train, lens, known, codes = fresh()
        for batch in batches:
            for i, t, held in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                words = words_of(t.as_py())
                codes += [known.setdefault(w, len(known)) for w in words]
                codes.append(0)
                ids.append(i)
                train.append(not held)
                lens.append(len(words) + 1)
                if len(codes) >= BLOCK_TOKENS:
                    yield row(ids, train, lens, known, codes)
                    number += 1
                    ids, train, lens, known, codes = fresh()
        if ids:
            yield row(ids, train, lens, known, codes)

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "block long, ids array<long>, train binary, lens binary, words binary, codes binary, tokens long")


class Block:
    """A block's tokens, their n-grams and what the buckets have answered so far."""

    def __init__(self, row, answers, least: int) -> None:
        import numpy as np

        self.least = least
        self.ids = list(row.get("ids", ()))
        self.words = np.frombuffer(row["words"], dtype="<u8")
        self.lens = np.frombuffer(row["lens"], dtype="<i8")
        self.codes = unpack(row["codes"], 4).astype(np.int64)
        stop = np.cumsum(self.lens)
        self.place = np.arange(len(self.codes)) - np.repeat(stop - self.lens, self.lens)  # within the document
        self.train = np.repeat(np.frombuffer(row["train"], dtype=np.uint8).astype(bool), self.lens)
        self.answers: dict[int, dict] = {}
        for kind, bucket, values in zip(answers["kind"], answers["bucket"], answers["values"], strict=True):
            self.answers.setdefault(kind, {})[bucket] = values
        # Level 0: keys are words.  grams[k] holds for level k: the tokens that have one, its distinct keys, and each's number.
        self.key = self.words[self.codes]
        self.grams = [(np.arange(len(self.codes)), self.words, self.codes)]
        self.counts: list = []

    def grow(self, level: int) -> None:
        """The n-grams of the next level: tokens whose context occurs often enough; level 1 takes all."""
        import numpy as np

        word = self.words[self.codes]
        before = np.roll(self.key, 1)
        if level == 1:
            before[self.place == 0] = END_HASH
        key = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (before >> np.uint64(31))
        key = (key + word) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
        at = np.arange(len(key))
        if level > 1:
            at = at[(self.place >= level - 1) & (np.roll(self.per_token(level - 1), 1) >= self.least * level)]
        self.key = key
        distinct, number = np.unique(key[at], return_inverse=True)
        self.grams.append((at, distinct, number))

    def fill(self, kind: int, keys, buckets: int):
        """The answers of a kind in the order of the keys."""
        import numpy as np

        order, to = deal(keys, kind, buckets)
        out = np.zeros(len(keys), dtype=np.int64)
        got = self.answers.get(kind, {})
        if len(keys):
            out[order] = np.concatenate([unpack(got[b], 4) for b in np.unique(to).tolist()])
        return out

    def per_token(self, level: int):
        """The training count of each token's n-gram of a level; 0 where it has none."""
        import numpy as np

        at, _, number = self.grams[level]
        out = np.zeros(len(self.codes), dtype=np.int64)
        out[at] = self.counts[level][number]
        return out

    def context_counts(self, level: int):
        """For each n-gram token of a level, its context's training count."""
        import numpy as np

        at = self.grams[level][0]
        if level == 1:
            return self.counts[0][np.where(self.place[at] == 0, 0, self.codes[at - 1])]
        return self.per_token(level - 1)[at - 1]

    def contexts(self, level: int):
        """The distinct contexts of a level's n-grams that occur often enough, the n-grams that have one, and each's number
        among them."""
        import numpy as np

        at = self.grams[level][0]
        if level == 1:
            number = np.where(self.place[at] == 0, 0, self.codes[at - 1])
            own = np.flatnonzero(self.counts[0][number] >= self.least)
            keys, number = self.words, number[own]
        else:
            own = np.arange(len(at))
            place = np.zeros(len(self.codes), dtype=np.int64)
            before, keys, found = self.grams[level - 1]
            place[before] = found
            number = place[at - 1]
        used, number = np.unique(number, return_inverse=True)
        return keys[used], own, number

    def local_counts(self, level: int):
        import numpy as np

        at, distinct, number = self.grams[level]
        return np.bincount(number[self.train[at]], minlength=len(distinct)).astype("<u4")

    def evidence(self, level: int):
        """Contexts, with this block's share of their kinds and of their divergence from their parents."""
        import numpy as np

        keys, own, number = self.contexts(level)
        at, _, mine = self.grams[level]
        use = self.train[at[own]]
        own, number = own[use], number[use]
        count, total = self.counts[level][mine][own], self.context_counts(level)[own]
        if level == 1:
            parent = self.counts[0][self.codes[at[own]]] / self.total
        else:
            up = np.zeros(len(self.codes))
            upper, _, n = self.grams[level - 1]
            up[upper] = self.counts[level - 1][n] / self.context_counts(level - 1).clip(1)
            parent = up[at[own]]
        add = lambda w: np.bincount(number, weights=w, minlength=len(keys)).astype("<f4")
        return keys, add(1 / count), add(np.log(count / total / parent))


def deal(keys, kind: int, buckets: int):
    """The order of the keys by bucket, then by what they are known by there, and the bucket of each in that order."""
    import numpy as np

    to = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.lexsort((keys & np.uint64((1 << 8 * width(kind)) - 1), to)) if width(kind) > 5 else np.argsort((to << np.uint64(40)) | (keys & np.uint64((1 << 40) - 1)), kind="stable")
    return order, to[order].astype(np.int64)


def restore(row, answers, least: int, levels: int, known: int, buckets: list[int], total: int) -> Block:
    """The block with the n-grams up to a level, those of the first levels counted."""
    b = Block(row, answers, least)
    b.total = max(1, total)
    for level in range(levels + 1):
        if level:
            b.grow(level)
        if level < known:
            b.counts.append(b.fill(2 * level, b.grams[level][1], buckets[2 * level]))
    return b


ASKED = "kind int, bucket int, block long, keys binary, a binary, b binary"


def ask(blocks: DataFrame, answers: DataFrame | None, level: int, depth: int, least: int, buckets: list[int], total: int) -> DataFrame:
    """What the blocks ask in a round: n-grams of the level (kind 2 * level; in round 1 words too), contexts of the last."""

    def run(own, got):
        import numpy as np
        import pandas as pd

        out: list[tuple] = []

        def post(block, kind, keys, a, b=None):
            order, to = deal(keys, kind, buckets[kind])
            keys, a, b = keys[order], a[order], b if b is None else b[order]
            show = (lambda x: pack(x, 4)) if b is None else (lambda x: x.tobytes())
            cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to)) if len(to) else [0]
            for s, e in zip(cuts, cuts[1:], strict=False):
                out.append((kind, int(to[s]), block, pack(keys[s:e], width(kind)), show(a[s:e]), None if b is None else show(b[s:e])))

        for _, r in own.iterrows():
            b = restore(r, got, least, min(level, depth), level if level > 1 else 0, buckets, total)
            if level == 1:
                post(r["block"], 0, b.words, b.local_counts(0))
            if level <= depth:
                post(r["block"], 2 * level, b.grams[level][1], b.local_counts(level))
            if level > 1:
                post(r["block"], 2 * (level - 1) + 1, *b.evidence(level - 1))
        return pd.DataFrame(out, columns=["kind", "bucket", "block", "keys", "a", "b"]).astype({"kind": "int32", "bucket": "int32", "block": "int64"})

    if answers is None:  # nothing is known yet: no shuffle of the blocks
        import pandas as pd

        empty = pd.DataFrame({"kind": [], "bucket": [], "values": []})

        def first(frames: Iterator) -> Iterator:
            for own in frames:
                yield run(own, empty)

        return blocks.drop("ids").mapInPandas(first, ASKED)
    return blocks.drop("ids").groupBy("block").cogroup(answers.groupBy("asker")).applyInPandas(run, ASKED)


def answer(asked: DataFrame, gain: float) -> DataFrame:
    """asker, kind, bucket, values: counts of n-grams, or kinds of retained contexts (0: not retained), in the order asked.
    Rows of asker -1 hold in values two numbers: the sum and the number of what is not 0."""

    def run(part):
        import numpy as np
        import pandas as pd

        part = part.sort_values("block")
        kind, bucket = int(part["kind"].iloc[0]), int(part["bucket"].iloc[0])
        rows = [unpack(x, width(kind)) for x in part["keys"]]
        keys, at = np.unique(np.concatenate(rows), return_inverse=True)
        if kind % 2 == 0:
            value = np.bincount(at, weights=np.concatenate([unpack(x, 4) for x in part["a"]]).astype(float), minlength=len(keys))
        else:
            kinds = np.round(np.bincount(at, weights=np.frombuffer(b"".join(part["a"]), dtype="<f4"), minlength=len(keys)))
            diverge = np.bincount(at, weights=np.frombuffer(b"".join(part["b"]), dtype="<f4"), minlength=len(keys))
            value = np.where((kinds > 0) & (diverge >= gain * kinds), kinds, 0)
        facts = np.array([value.sum(), np.count_nonzero(value)], dtype="<i8").tobytes()
        value = np.minimum(value, 2**32 - 1).astype(np.uint64)[at]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        values = [pack(value[a:b], 4) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({"asker": [-1, *part["block"]], "kind": kind, "bucket": bucket, "values": [facts, *values]}).astype({"asker": "int64", "kind": "int32", "bucket": "int32"})

    return asked.groupBy("kind", "bucket").applyInPandas(run, "asker long, kind int, bucket int, values binary")


def facts(answers: DataFrame, kind: int) -> tuple[int, int]:
    """Sum and number of a kind's values; buckets are few enough to add up here as one row each."""
    import struct

    rows = answers.where((F.col("asker") == -1) & (F.col("kind") == kind)).select("values").toLocalIterator()
    sums = [0, 0]
    for r in rows:
        for i, x in enumerate(struct.unpack("<2q", bytes(r["values"]))):
            sums[i] += x
    return sums[0], sums[1]


def finish(blocks: DataFrame, answers: DataFrame, depth: int, least: int, discount: float, buckets: list[int], total: int, distinct: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""

    def run(own, got):
        import numpy as np
        import pandas as pd

        frames = []
        for _, r in own.iterrows():
            b = restore(r, got, least, depth, depth + 1, buckets, total)
            seen = b.counts[0][b.codes]
            p = (seen + 1) / (total + distinct + 1)
            base = np.log10(p)
            for level in range(1, depth + 1):
                keys, own, number = b.contexts(level)
                kinds = b.fill(2 * level + 1, keys, buckets[2 * level + 1])[number]
                own, kinds = own[kinds > 0], kinds[kinds > 0]
                at, _, mine = b.grams[level]
                at, of = at[own], b.context_counts(level)[own]
                p[at] = np.maximum(b.counts[level][mine][own] - discount, 0) / of + discount * kinds / of * p[at]
            doc = np.repeat(np.arange(len(b.ids)), b.lens)
            add = lambda w: np.bincount(doc, weights=w, minlength=len(b.ids))  # noqa: B023, E731
            frames.append(pd.DataFrame({"doc_id": pd.array(b.ids, dtype="Int64"), "n_tokens": b.lens, "n_known": add(seen > 0).astype("int64"), "base_score": add(base), "score": add(np.log10(p))}))
        return pd.concat(frames) if frames else pd.DataFrame({k: [] for k in ("doc_id", "n_tokens", "n_known", "base_score", "score")})

    return blocks.groupBy("block").cogroup(answers.groupBy("asker")).applyInPandas(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, depth: int = 2, least: int = 2, gain: float = 1.0, discount: float = 0.75) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and tree_contexts (retained)."""
    spark = docs.sparkSession
    since = len(written(spark))
    held = F.coalesce(crc32_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    blocks = materialise(read_blocks(pick(docs, "doc_id", "text").withColumn("held_out", held)), "blocks")
    size = blocks.agg(F.sum("tokens").alias("tokens"), F.sum(F.length("words") / 8).alias("words")).first()
    share = lambda n: max(1, math.ceil((n or 0) / KEYS_PER_BUCKET))
    # Of each kind: words, (no contexts,) then n-grams and contexts of each level.
    buckets = [share(size["words"]), 1, *[share(size["tokens"])] * (2 * depth)]
    answers, total, distinct, retained = None, 0, 0, 0
    for level in range(1, depth + 2):
        asked = ask(blocks, answers, level, depth, least, buckets, total)
        fresh = materialise(answer(asked, gain), "answers")
        if level == 1:
            total, distinct = facts(fresh, 0)
        else:
            retained += facts(fresh, 2 * (level - 1) + 1)[1]
        told = fresh.where("asker >= 0")
        answers = told if answers is None else answers.unionByName(told)
        del asked, fresh, told
        sweep(spark, len(written(spark)))  # shuffle files of the round go
    out = finish(blocks, answers, depth, least, discount, buckets, total, distinct)
    out = materialise(out, "scores")
    sweep(spark, since, out)
    held = F.coalesce(crc32_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", F.lit(retained).cast("long").alias("tree_contexts"))
