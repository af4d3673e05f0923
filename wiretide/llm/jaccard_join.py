"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents with one word sequence are one class, represented by its least id.  Classes A and B link when
100 * |A and B| >= 75 * |A or B| over their sets of word shingles (held as 64-bit hashes), so that each needs at least
T(n) = ceil(0.75 n) shingles of the other.  No stage compares everything with everything:

1. Sieve.  In hash order a class posts its first n - T(n) + c(n) shingles, c(n) = max(1, n // 10).  Linked classes have
   c(T(n)) of these in common at least, so a class with fewer shared ones links with nothing and goes.
2. Index.  Over what remains, list lengths are counted, and each set is ordered by them, rarest first.  Shingles of one
   class only match nothing; of the others, those among the first n - T(n) + 1 make the short inverted lists: linked
   classes share one.
3. Stars.  Each class is searched for from those few centres with which it shares most short lists, the centres being
   drawn from the lists: the centre's shingles are the query, the classes around it the index.  Links found are joined
   into components; large groups of near copies collapse here.  A second turn draws other centres from other components.
4. Rest.  Lists are recounted by component: a shingle that one component alone holds leaves the index, and with it every
   class that has less than T(n) shingles left.  What is left bounds the size of a partner too, and a shingle that larger
   classes alone hold is of no use then: so classes that share a template, but too little of it, leave here.  The classes of a component that stand in one block form a profile, the
   union of their shingles.  Each class then searches the profiles of larger components (by size, then by name) that it
   meets in its short lists: whatever it links with lies in a profile holding at least as many of its shingles.  The few
   profiles found are opened, and the class searches their members.  Every two components that a link joins are found.

Both searches of step 4 and that of step 3 are DivideSkip: the short lists of a query are merged by counting, long ones are
probed by binary search (or merged too, where so much is left that this is less work), and what reaches the required overlap
stays.  No step gives out the pairs of a list.  In step 4 classes and profiles meet by the largest component that holds a
list of both: the classes of one template travel once, not once for each list they share.

Cells of such components are counted before they are shuffled, large ones, profiles and stars are split into bounded parts,
and copies never reach a list.  Cases: null text has no words; a document without words has no shingle, links with nothing and is its own
component.  With fewer words than ``width`` the whole sequence is the one shingle.  A null id takes no part in naming a
component.  Repeated rows and repeated ids are copies or separate texts as their texts are; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pick, sweep, unused, written
from .components import components

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
POSTINGS_PER_BUCKET = 1_500_000
BLOCK = 1_000_000
ENTRIES_PER_CELL = 500_000
LONG_LIST = 20_000  # rows of one side of a cell
CHUNK = 512
TURNS = 2
CENTRES = 3
MU = 0.0085  # weighs merging against probing
COMMON = 64  # rows of a list that is rather probed
LOOK_UP = 5_000  # what a look into a list costs besides the search itself, in rows merged
BATCH_BYTES = 50_000_000


def required(n: int) -> int:
    """Least overlap that any link of a set of n needs."""
    return -(-NUMERATOR * n // DENOMINATOR)


def overlap_needed(na, nb):
    """Least overlap that links sets of these sizes: J >= p/q means (p + q) * overlap >= p * (na + nb)."""
    return -(-(NUMERATOR * (na + nb)) // (NUMERATOR + DENOMINATOR))


def largest_partner(n: int, overlap: int) -> int:
    """The largest set that an overlap can link with one of n."""
    return (NUMERATOR + DENOMINATOR) * overlap // NUMERATOR - n


def within_reach(n: int, lists, small):
    """Of a class's lists (places in small, the size of the smallest class that holds each) those that a link can use.

    What a class links with is no larger than its remaining lists allow, so a list of larger classes alone is of no use;
    without it fewer lists remain, and so on until nothing changes."""
    while len(lists):
        kept = lists[small[lists] <= largest_partner(n, len(lists))]
        if len(kept) == len(lists):
            break
        lists = kept
    return lists


class Shingler:
    """Word sequences to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, width: int) -> None:
        import xxhash

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > 500_000:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.width, self.words, self.digest = width, Words(), xxhash.xxh3_128_digest
        self.lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def sequence(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").translate(self.lower).split()

    def key(self, words: list[bytes]) -> tuple[int, int]:
        d = self.digest(b" ".join(words))
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)

    def shingles(self, words: list[bytes]):
        import numpy as np

        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=n)
        w = min(n, self.width)
        acc = np.full(n - w + 1, np.uint64(w), dtype=np.uint64)
        for k in range(w):
            acc = (acc ^ h[k : n - w + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
        return np.unique(acc)


def _arrow(rows: dict, types: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in types.items()], list(types))


def _runs(values, order) -> list:
    """(value, places) of each value that occurs; order sorts the values."""
    import numpy as np

    v = values[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])), len(v)) if len(v) else [0]
    return [(int(v[a]), order[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def keys(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t (hash of the text), n (set size), h1 and h2 (of the word sequence)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = Shingler(width)
        for batch in batches:
            n, h1, h2 = [], [], []
            for t in batch.column("text"):
                words = s.sequence(t.as_py())
                a, b = s.key(words)
                n.append(len(s.shingles(words)))
                h1.append(a)
                h2.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "t", "n", "h1", "h2"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, n long, h1 long, h2 long")


def sieve(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """h1, shared: how many of each class's posted shingles another class posts too (never too few)."""

    def post(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = {"bucket": pa.int32(), "hashes": pa.binary(), "classes": pa.binary(), "many": pa.binary()}
        s = Shingler(width)
        sets: list = []
        owners: list[int] = []
        seen: set[int] = set()
        size = 0

        def flush():
            h = np.concatenate(sets)
            c = np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in sets])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            length = np.diff(np.append(start, len(h)))
            local = np.repeat(length > 1, length)
            who, times = np.unique(c[local], return_counts=True)  # shared within the block: counted here, sent on once
            h, c, many = h[start], c[start], length > 1
            to = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            out = {k: [] for k in kinds}
            for b, i in _runs(to, order):
                for k, v in zip(kinds, (b, h[i].tobytes(), c[i].tobytes(), many[i].tobytes()), strict=True):
                    out[k].append(v)
            # Counts travel as rows of the same shape: bucket by class, with no "many" bytes.
            cb = (who % buckets).astype(np.int32)
            for b in np.unique(cb):
                for k, v in zip(kinds, (int(b), times[cb == b].astype("<u8").tobytes(), who[cb == b].tobytes(), b""), strict=True):
                    out[k].append(v)
            return _arrow(out, kinds)

        for batch in batches:
            for t in batch.column("text"):
                words = s.sequence(t.as_py())
                if not words:
                    continue
                key = s.key(words)[0]
                if key in seen:
                    continue
                seen.add(key)
                x = s.shingles(words)
                sets.append(x[: len(x) - required(len(x)) + max(1, len(x) // 10)])
                owners.append(key)
                size += len(sets[-1])
                if size >= BLOCK:
                    yield flush()
                    sets, owners, seen, size = [], [], set(), 0
        if size:
            yield flush()

    def count(part):
        import numpy as np
        import pandas as pd

        posts = part[part["many"].str.len() > 0]
        done = part[part["many"].str.len() == 0]
        who = [np.frombuffer(b"".join(done["classes"]), dtype="<i8")]
        times = [np.frombuffer(b"".join(done["hashes"]), dtype="<u8").astype("int64")]
        if len(posts):
            h = np.frombuffer(b"".join(posts["hashes"]), dtype="<u8")
            c = np.frombuffer(b"".join(posts["classes"]), dtype="<i8")
            m = np.frombuffer(b"".join(posts["many"]), dtype=bool)
            order = np.argsort(h, kind="stable")
            h, c, m = h[order], c[order], m[order]
            again = np.zeros(len(h), dtype=bool)
            same = h[1:] == h[:-1]
            again[1:] |= same
            again[:-1] |= same
            keep = again & True
            h, c, m = h[keep], c[keep], m[keep]
            if len(h):
                order = np.lexsort((c, h))
                h, c, m = h[order], c[order], m[order]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                several = (np.bincount(run, weights=new) > 1) | (np.bincount(run, weights=m) > 0)
                w, k = np.unique(c[new & ~m & several[run]], return_counts=True)
                who.append(w)
                times.append(k)
        return pd.DataFrame({"h1": np.concatenate(who), "shared": np.concatenate(times)})

    posted = docs.select("text").mapInArrow(post, "bucket int, hashes binary, classes binary, many binary")
    return posted.groupBy("bucket").applyInPandas(count, "h1 long, shared long").groupBy("h1").agg(F.sum("shared").alias("shared"))


def blocks(docs: DataFrame, survivors: DataFrame, width: int) -> DataFrame:
    """One row for each block of surviving classes: block, nodes, sizes and sets (concatenated arrays)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"block": pa.int64(), "nodes": pa.binary(), "sizes": pa.binary(), "sets": pa.binary()}
        s, number = Shingler(width), TaskContext.get().partitionId() << 24
        nodes: list[int] = []
        sets: list = []
        size = 0

        def row():
            return _arrow({"block": [number], "nodes": [np.array(nodes, dtype="<i8").tobytes()], "sizes": [np.array([len(x) for x in sets], dtype="<i8").tobytes()], "sets": [np.concatenate(sets).tobytes()]}, kinds)

        for batch in batches:
            for t, node, h1, h2 in zip(batch.column("text"), *[batch.column(k).to_pylist() for k in ("node", "h1", "h2")], strict=True):
                words = s.sequence(t.as_py())
                if s.key(words) != (h1, h2):
                    continue  # another text under the same id
                nodes.append(node)
                sets.append(s.shingles(words))
                size += len(sets[-1])
                if size >= BLOCK:
                    yield row()
                    number += 1
                    nodes, sets, size = [], [], 0
        if nodes:
            yield row()

    # Survivors grow with the documents, so this is a shuffle join at every size.
    wanted = survivors.select(F.col("first_doc").alias("doc_id"), "node", "h1", "h2").hint("shuffle_merge")
    joined = pick(docs, "doc_id", "text").join(wanted, "doc_id")
    return joined.select("text", "node", "h1", "h2").mapInArrow(run, "block long, nodes binary, sizes binary, sets binary")


def index(sets: DataFrame, buckets: int) -> DataFrame:
    """node, n, shared (its sorted shingles that other classes have too), prefix and ranks (its short lists, and where
    each stands in the class's order); only classes that have a short list."""

    def tally(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = {"bucket": pa.int32(), "block": pa.int64(), "hashes": pa.binary(), "counts": pa.binary()}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("sets"), strict=True):
                h, times = np.unique(np.frombuffer(raw.as_py(), dtype="<u8"), return_counts=True)
                to = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                parts = _runs(to, order)
                yield _arrow({"bucket": [b for b, _ in parts], "block": [block] * len(parts), "hashes": [h[i].tobytes() for _, i in parts], "counts": [times[i].astype("<i8").tobytes() for _, i in parts]}, kinds)

    def total(part):
        import numpy as np
        import pandas as pd

        h = np.frombuffer(b"".join(part["hashes"]), dtype="<u8")
        c = np.frombuffer(b"".join(part["counts"]), dtype="<i8")
        whose = np.repeat(part["block"].to_numpy(), part["hashes"].str.len().to_numpy() // 8)
        order = np.argsort(h, kind="stable")
        h, c, whose = h[order], c[order], whose[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=int)
        df = np.repeat(np.add.reduceat(c, start), np.diff(np.append(start, len(h)))) if len(h) else c
        keep = df > 1
        h, df, whose = h[keep], df[keep], whose[keep]
        order = np.argsort(whose, kind="stable")
        names, first = np.unique(whose[order], return_index=True)
        cuts = np.append(first, len(order))
        return pd.DataFrame({"block": names, "hashes": [h[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], "df": [df[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]})

    def order(part, lengths):
        import numpy as np
        import pandas as pd

        out: list[tuple] = []
        if len(part) and len(lengths):
            known = np.frombuffer(b"".join(lengths["hashes"]), dtype="<u8")
            df = np.frombuffer(b"".join(lengths["df"]), dtype="<i8")
            by = np.argsort(known)
            known, df = known[by], df[by]
            for row in part.itertuples(index=False):
                at = 0
                flat = np.frombuffer(row.sets, dtype="<u8")
                for node, n in zip(np.frombuffer(row.nodes, dtype="<i8"), np.frombuffer(row.sizes, dtype="<i8"), strict=True):
                    x = flat[at : at + n]
                    at += n
                    i = np.searchsorted(known, x)
                    hit = (i < len(known)) & (known[np.minimum(i, len(known) - 1)] == x)
                    shared, length = x[hit], df[i[hit]]
                    n = int(n)
                    alone = n - len(shared)
                    short = n - required(n) + 1 - alone
                    if short > 0:
                        o = np.lexsort((shared, length))[:short]
                        out.append((node, n, shared.tobytes(), shared[o].tobytes(), np.arange(alone, alone + len(o), dtype="<i8").tobytes()))
        return pd.DataFrame(out, columns=["node", "n", "shared", "prefix", "ranks"]).astype({"node": "int64", "n": "int64"})

    tallies = sets.select("block", "sets").mapInArrow(tally, "bucket int, block long, hashes binary, counts binary")
    lengths = tallies.groupBy("bucket").applyInPandas(total, "block long, hashes binary, df binary")
    return sets.groupBy("block").cogroup(lengths.groupBy("block")).applyInPandas(order, "node long, n long, shared binary, prefix binary, ranks binary")


def postings(idx: DataFrame) -> DataFrame:
    """shingle, node, n, rank: the entries of the short lists."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lens = np.array([len(x.as_py()) // 8 for x in batch.column("prefix")])
            if lens.sum():
                column = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<i8")  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(column("prefix")), pa.array(np.repeat(batch.column("node").to_numpy(), lens)), pa.array(np.repeat(batch.column("n").to_numpy(), lens)), pa.array(column("ranks"))], ["shingle", "node", "n", "rank"])

    return idx.select("node", "n", "prefix", "ranks").mapInArrow(run, "shingle long, node long, n long, rank long")


def set_aside(t: int, longest: int, mu: float = MU) -> int:
    """How many of the longest lists are probed, not merged."""
    return min(t - 1, int(t / (mu * math.log2(1 + longest) + 1)))


def occurrences(lists: list, t: int, aside: int | None = None, mu: float = MU):
    """Members found in at least t of the sorted lists (arrays of small numbers), and their counts.

    The L longest lists are set aside (``aside``, or as many as pays by their length).  The others are merged by counting; a
    member that fewer than t - L of them hold cannot reach t.  What remains is looked up in the long lists by binary search,
    and goes as soon as the lists left cannot bring it to t; where so many remain that this costs more, the long lists are
    merged too.
    """
    import numpy as np

    t = max(1, t)
    lists = sorted((x for x in lists if len(x)), key=len)
    none = np.zeros(0, dtype=np.int64)
    if len(lists) < t:
        return none, none
    aside = set_aside(t, len(lists[-1]), mu) if aside is None else min(aside, t - 1)
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    counts = np.bincount(np.concatenate(short))
    found = np.flatnonzero(counts >= t - aside)
    counts = counts[found]
    if not len(found) or not long:
        return found, counts
    merging = sum(map(len, long))
    if len(long) * (LOOK_UP + 4 * len(found) * math.log2(1 + len(long[-1]))) > merging:
        more = np.bincount(np.concatenate(long), minlength=int(found[-1]) + 1)
        counts = counts + more[found]
    else:
        for left, x in enumerate(long):
            alive = counts + (len(long) - left) >= t
            found, counts = found[alive], counts[alive]
            if not len(found):
                break
            counts = counts + (x[np.minimum(np.searchsorted(x, found), len(x) - 1)] == found)
    return found[counts >= t], counts[counts >= t]


def divide_skip(lists: list, t: int, aside: int | None = None, mu: float = MU) -> dict[int, int]:
    """Members found in at least t of the sorted lists, with their counts."""
    import numpy as np

    found, counts = occurrences([np.asarray(x, dtype=np.int64) for x in lists], t, aside, mu)
    return dict(zip(found.tolist(), counts.tolist(), strict=True))


def search(pairs: DataFrame, idx: DataFrame, label: str) -> DataFrame:
    """The links among (centre, node, chunk): each chunk's nodes are indexed, the centre is the query.

    Most centres have few nodes, so the rows of a task pass in order and one centre's chunk is held at a time."""
    sets = idx.select("node", "n", F.col("shared").alias("x"))
    around = pairs.join(sets, "node").select("centre", "chunk", F.lit(1).alias("kind"), "node", "n", "x")
    middle = pairs.select(F.col("centre").alias("node"), "chunk").distinct().join(sets, "node").select(F.col("node").alias("centre"), "chunk", F.lit(0).alias("kind"), "node", "n", "x")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def hits(query: tuple, near: list[tuple]):
            (qid, qn, q), n = query, np.array([r[1] for r in near])
            q, x = np.frombuffer(q, dtype="<u8"), np.frombuffer(b"".join([r[2] for r in near]), dtype="<u8")
            if not len(q):
                return
            row = np.repeat(np.arange(len(near)), [len(r[2]) // 8 for r in near])
            at = np.searchsorted(q, x)
            hit = q[np.minimum(at, len(q) - 1)] == x
            row, at = row[hit], at[hit]
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            found, counts = occurrences([row[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], int(overlap_needed(qn, min(qn, int(n.min())))))
            for k in found[DENOMINATOR * counts >= NUMERATOR * (qn + n[found] - counts)].tolist():
                links["a"].append(qid)
                links["b"].append(near[k][0])

        kinds = {"a": pa.int64(), "b": pa.int64()}
        links: dict[str, list] = {k: [] for k in kinds}
        key, query, near = None, None, []
        for batch in batches:
            for centre, chunk, kind, *row in zip(*[batch.column(k).to_pylist() for k in ("centre", "chunk", "kind", "node", "n", "x")], strict=True):
                if (centre, chunk) != key:
                    if query and near:
                        hits(query, near)
                    key, query, near = (centre, chunk), None, []
                if kind:
                    near.append(row)
                else:
                    query = row
            yield _arrow(links, kinds)
            links = {k: [] for k in kinds}
        if query and near:
            hits(query, near)
        yield _arrow(links, kinds)

    rows = around.unionByName(middle).repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "kind")
    return materialise(rows.mapInArrow(run, "a long, b long"), label)


def stars(idx: DataFrame, comps: DataFrame | None, turn: int) -> DataFrame:
    """centre, node, chunk: each class under the few centres of other components with which it shares most short lists.

    A list's centre is drawn by a hash that changes with every turn."""
    entries = postings(idx).select("shingle", "node")
    entries = entries.withColumn("component", F.col("node")) if comps is None else entries.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    entries = materialise(entries, "star-entries")
    pick_one = F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn)))
    centres = entries.groupBy("shingle").agg(pick_one.alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    centres = materialise(centres.select("shingle", F.col("c.node").alias("centre"), F.col("c.component").alias("other")), "centres")
    shared = entries.join(centres, "shingle").where("component != other").groupBy("node", "centre").count()
    # A class has no more centres than short lists, so the list that is sorted is bounded by its own size.
    ranked = F.sort_array(F.collect_list(F.struct("count", "centre")), asc=False)
    best = materialise(shared.groupBy("node").agg(F.slice(ranked, 1, CENTRES).alias("best")).select("node", F.explode("best.centre").alias("centre")), "stars")
    chunks = best.groupBy("centre").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    return materialise(best.join(chunks, "centre").select("centre", "node", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk")), "stars")


def recount(idx: DataFrame, comps: DataFrame) -> DataFrame:
    """What lists by component leave: rows of classes (kind 0) and of profiles (kind 1).

    profile; kind; node (of a class) ; n (a profile's: the least of its classes); x: the shingles that several components
    hold (a profile's: the union); meets: the largest components that hold the short lists in which larger components (for a
    profile: smaller ones) may be met.  A component's code orders by size (as a power of two), then name."""
    size = F.floor(F.log2(F.count("*"))).cast("long")
    codes = comps.groupBy("component").agg((F.shiftleft(size, 57) + F.col("component")).alias("code"))
    coded = comps.join(codes, "component").select("node", "code")
    # Sorted by component, so that one stands in few blocks; a large one may still be split between partitions.
    rows = idx.select("node", "n", "shared").join(coded, "node", "left").withColumn("code", F.coalesce("code", "node"))
    rows = rows.repartitionByRange("code", "node").sortWithinPartitions("code", "node")

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"block": pa.int64(), **dict.fromkeys(("nodes", "sizes", "codes", "lens", "sets"), pa.binary())}
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def row():
            longs = lambda x: np.array(x, dtype="<i8").tobytes()
            node, n, code, sets = zip(*held, strict=True)
            return _arrow({"block": [number], "nodes": [longs(node)], "sizes": [longs(n)], "codes": [longs(code)], "lens": [longs([len(x) // 8 for x in sets])], "sets": [b"".join(sets)]}, kinds)

        for batch in batches:
            for h in zip(*[batch.column(k).to_pylist() for k in ("node", "n", "code", "shared")], strict=True):
                held.append(h)
                size += len(h[3]) // 8
                if size >= BLOCK:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    packed = rows.select("node", "n", "code", "shared").mapInArrow(pack, "block long, nodes binary, sizes binary, codes binary, lens binary, sets binary")
    packed = materialise(packed, "packed")
    entries = packed.agg(F.sum(F.length("sets") / 8)).first()[0] or 0
    buckets = max(1, math.ceil(entries / POSTINGS_PER_BUCKET))

    def tally(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = {"bucket": pa.int32(), "block": pa.int64(), **dict.fromkeys(("hashes", "lo", "hi", "many", "small"), pa.binary())}
        for batch in batches:
            for r in batch.to_pylist():
                h = np.frombuffer(r["sets"], dtype="<u8")
                if not len(h):
                    continue
                lens = np.frombuffer(r["lens"], dtype="<i8")
                c, n = (np.repeat(np.frombuffer(r[k], dtype="<i8"), lens) for k in ("codes", "sizes"))
                order = np.lexsort((n, c, h))
                h, c, n = h[order], c[order], n[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                h, c, n = h[new], c[new], n[new]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                stop = np.append(start[1:], len(h))
                h, lo, hi, many, small = h[start], c[start], c[stop - 1], stop - start, np.minimum.reduceat(n, start)
                to = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                parts = _runs(to, np.argsort(to, kind="stable"))
                yield _arrow({"bucket": [b for b, _ in parts], "block": [r["block"]] * len(parts), **{k: [v[i].tobytes() for _, i in parts] for k, v in (("hashes", h), ("lo", lo), ("hi", hi), ("many", many.astype("<i8")), ("small", small))}}, kinds)

    def total(part):
        import numpy as np
        import pandas as pd

        h, lo, hi, many, small = (np.frombuffer(b"".join(part[k]), dtype=t) for k, t in (("hashes", "<u8"), ("lo", "<i8"), ("hi", "<i8"), ("many", "<i8"), ("small", "<i8")))
        whose = np.repeat(part["block"].to_numpy(), part["hashes"].str.len().to_numpy() // 8)
        order = np.argsort(h, kind="stable")
        h, lo, hi, many, small, whose = h[order], lo[order], hi[order], many[order], small[order], whose[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        each = np.diff(np.append(start, len(h)))
        lo, hi, many, small = (np.repeat(f.reduceat(v, start), each) for f, v in ((np.minimum, lo), (np.maximum, hi), (np.add, many), (np.minimum, small)))
        keep = np.flatnonzero(lo != hi)
        parts = _runs(whose[keep], np.argsort(whose[keep], kind="stable"))
        return pd.DataFrame({"block": [b for b, _ in parts], **{k: [v[keep[i]].tobytes() for _, i in parts] for k, v in (("hashes", h), ("lo", lo), ("hi", hi), ("many", many), ("small", small))}}).astype({"block": "int64"})

    columns = ["profile", "kind", "node", "n", "x", "meets"]

    def remain(part, lists):
        import numpy as np
        import pandas as pd

        out: list[tuple] = []
        if len(part) and len(lists):
            r = part.iloc[0]
            known, lo, hi, many, small = (np.frombuffer(b"".join(lists[k]), dtype=t) for k, t in (("hashes", "<u8"), ("lo", "<i8"), ("hi", "<i8"), ("many", "<i8"), ("small", "<i8")))
            by = np.argsort(known)
            known, lo, hi, many, small = known[by], lo[by], hi[by], many[by], small[by]
            flat, at = np.frombuffer(r["sets"], dtype="<u8"), 0
            profiles: dict[int, list] = {}
            for node, n, code, length in zip(*[np.frombuffer(r[k], dtype="<i8").tolist() for k in ("nodes", "sizes", "codes", "lens")], strict=True):
                x = flat[at : at + length]
                at += length
                i = np.searchsorted(known, x)
                i = i[(i < len(known)) & (known[np.minimum(i, len(known) - 1)] == x)]
                i = within_reach(n, i, small)
                if len(i) < required(n):
                    continue
                short = i[np.lexsort((known[i], many[i]))[: n - required(n) + 1 - (n - len(i))]]
                up = short[hi[short] > code]
                p = profiles.setdefault(code, [(r["block"] << 24) + len(profiles), n, [], []])
                p[1] = min(p[1], n)
                p[2].append(i)
                p[3].append(short[lo[short] < code])
                out.append((p[0], 0, node, n, known[i].tobytes(), np.unique(hi[up])))
            for name, n, sets, meets in profiles.values():
                x, down = np.unique(np.concatenate(sets)), np.unique(np.concatenate(meets))
                if len(down):
                    out.append((name, 1, -1, n, known[x].tobytes(), np.unique(hi[down])))
        return pd.DataFrame(out, columns=columns).astype({"profile": "int64", "kind": "int32", "node": "int64", "n": "int64"})

    tallies = packed.select("block", "sizes", "codes", "lens", "sets").mapInArrow(tally, "bucket int, block long, hashes binary, lo binary, hi binary, many binary, small binary")
    lists = tallies.groupBy("bucket").applyInPandas(total, "block long, hashes binary, lo binary, hi binary, many binary, small binary")
    rest = packed.groupBy("block").cogroup(lists.groupBy("block")).applyInPandas(remain, "profile long, kind int, node long, n long, x binary, meets array<long>")
    return materialise(rest, "rest")


def _found(rows, indexed, floor) -> Iterator:
    """(row, indexed rows, overlaps) of what reaches floor(n, n): rows are queries, indexed rows the lists, both with n and x."""
    import numpy as np

    lengths = indexed["x"].str.len().to_numpy() // 8
    known = np.frombuffer(b"".join(indexed["x"]), dtype="<u8")
    order = np.argsort(known, kind="stable")
    known, names = known[order], np.repeat(np.arange(len(indexed)), lengths)[order]
    first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]])) if len(known) else np.zeros(0, dtype=int)
    stop = np.append(first[1:], len(known)).astype(int)
    known = known[first]
    kinds, kind = np.unique(indexed["n"].to_numpy(), return_inverse=True)
    least = int(kinds[0]) if len(kinds) else 0
    needs: dict[int, dict] = {}
    for k, (n, raw) in enumerate(zip(rows["n"].tolist(), rows["x"], strict=True)):
        x = np.frombuffer(raw, dtype="<u8")
        i = np.searchsorted(known, x)
        i = i[(i < len(known)) & (known[np.minimum(i, len(known) - 1)] == x)] if len(known) else i[:0]
        t = max(required(n), int(floor(n, least)))  # no indexed row asks for less
        if len(i) < t:
            continue
        # Lists that many rows share are set aside as far as t allows: where none of the members of the others can still
        # reach t, a common template is not looked at.
        lens = stop[i] - first[i]
        aside = max(set_aside(t, int(lens.max())), int(np.count_nonzero(lens > COMMON)))
        m, c = occurrences([names[a:b] for a, b in zip(first[i].tolist(), stop[i].tolist(), strict=True)], t, aside)
        if not len(m):
            continue
        known_needs = needs.setdefault(n, {})
        sizes, which = np.unique(kind[m], return_inverse=True)
        for s in sizes.tolist():
            if s not in known_needs:
                known_needs[s] = int(floor(n, int(kinds[s])))
        enough = c >= np.array([known_needs[s] for s in sizes.tolist()])[which]
        if enough.any():
            yield k, m[enough], c[enough]


def _queries(rows, indexed, floor) -> list[tuple[int, int, int]]:
    """The finds of ``_found`` one by one."""
    return [(k, m, c) for k, ms, cs in _found(rows, indexed, floor) for m, c in zip(ms.tolist(), cs.tolist(), strict=True)]


def opened(rest: DataFrame) -> DataFrame:
    """node, profile: each class with the profiles of larger components that hold as many of its shingles as a link needs.

    Classes and profiles meet in the cell of the largest component that holds a list of both.  A template's lists have one
    such component, so that its classes travel once and two rows are compared once, not for each list they share.  Cells are
    counted before: small ones are put together, a large one is dealt out, each part of its classes against each part of its
    profiles."""
    mine = [F.sum(F.when(F.col("kind") == k, v).otherwise(0)) for k in (0, 1) for v in (F.length("x") / 8, F.lit(1))]
    cells = rest.select("kind", "x", F.explode("meets").alias("cell")).groupBy("cell").agg(*[c.alias(a) for c, a in zip(mine, ("x0", "n0", "x1", "n1"), strict=True)])
    cells = materialise(cells.where("n0 > 0 AND n1 > 0"), "cells")
    buckets = max(1, math.ceil((cells.agg(F.sum(F.col("x0") + F.col("x1"))).first()[0] or 0) / ENTRIES_PER_CELL))
    parts = [F.ceil(F.greatest(F.col(f"x{k}") / ENTRIES_PER_CELL, F.col(f"n{k}") / LONG_LIST)).cast("int").alias(f"p{k}") for k in (0, 1)]
    large = {r["cell"]: (r["p0"], r["p1"]) for r in cells.select("cell", *parts).where("p0 > 1 OR p1 > 1").collect()}

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"cell": pa.int64(), "i": pa.int32(), "j": pa.int32(), "profile": pa.int64(), "kind": pa.int32(), "node": pa.int64(), "n": pa.int64(), "x": pa.binary()}
        for batch in batches:
            for r in batch.to_pylist():
                to = set()
                for c in r["meets"]:
                    if c not in large:
                        to.add((-1 - c * 2654435761 % 2**32 % buckets, 0, 0))
                        continue
                    own = (r["profile"] if r["kind"] else r["node"]) * 2654435761 % 2**32 % large[c][r["kind"]]
                    to.update((c, *((p, own) if r["kind"] else (own, p))) for p in range(large[c][1 - r["kind"]]))
                to, step = sorted(to), max(1, min(1000, BATCH_BYTES // max(1, len(r["x"]))))
                for start in range(0, len(to), step):
                    some = to[start : start + step]
                    yield _arrow({"cell": [c[0] for c in some], "i": [c[1] for c in some], "j": [c[2] for c in some], **{k: [r[k]] * len(some) for k in ("profile", "kind", "node", "n", "x")}}, kinds)

    def probe(part):
        import pandas as pd

        a, b = part[part["kind"] == 0], part[part["kind"] == 1]
        got = []
        if len(a) and len(b):
            own, other = a["profile"].to_numpy(), b["profile"].to_numpy()
            # A profile holds at least the overlap that a link with its smallest class needs; its own component never counts
            # (a class's lists name only components of greater code, but a profile of its own may meet others in the cell).
            found = _queries(a, b, lambda n, m: int(overlap_needed(n, max(m, required(n)))))
            got = [(a["node"].iat[k], other[m]) for k, m, _ in found if own[k] != other[m]]
        return pd.DataFrame(got, columns=["node", "profile"]).astype("int64")

    dealt = rest.where(F.size("meets") > 0).mapInArrow(deal, "cell long, i int, j int, profile long, kind int, node long, n long, x binary")
    return materialise(dealt.groupBy("cell", "i", "j").applyInPandas(probe, "node long, profile long").distinct(), "opened")


def members(rest: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: for each class and profile found, the profile's class of the greatest overlap that links with it."""
    classes = rest.where("kind = 0").select("profile", "node", "n", "x")
    parts = found.groupBy("profile").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    asking = found.join(classes.select("node", "n", "x"), "node").join(parts, "profile")
    asking = asking.select(F.col("profile").alias("asked"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("q_part"), F.col("node").alias("q_node"), F.col("n").alias("q_n"), F.col("x").alias("q_x"))
    inside = classes.join(parts, "profile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("profile", "part", "node", "n", "x")

    def run(queries, index):
        import pandas as pd

        best: dict[int, tuple] = {}
        if len(queries) and len(index):
            queries = queries.rename(columns={f"q_{k}": k for k in ("node", "n", "x")})
            a, b = queries["node"].tolist(), index["node"].to_numpy()
            for k, ms, cs in _found(queries, index, lambda n, m: int(overlap_needed(n, m))):
                others = b[ms] != a[k]
                if others.any():
                    c = int(cs[others].max())
                    best[a[k]] = max(best.get(a[k], (0, 0)), (c, int(b[ms][others & (cs == c)].max())))
        return pd.DataFrame([(a, b) for a, (_, b) in best.items()], columns=["a", "b"]).astype("int64")

    return materialise(asking.groupBy("asked", "q_part").cogroup(inside.groupBy("profile", "part")).applyInPandas(run, "a long, b long"), "links")


def _linked(docs: DataFrame, width: int) -> DataFrame:
    """For each document: doc_id, t (hash of the text), n_shingles, component_id, n_copies, and names: whether its class is
    the one that gives the component its name (one class even where an id stands for several texts)."""
    since = len(written(docs.sparkSession))
    seen = materialise(keys(docs, width), "keys")
    total = seen.agg(F.sum("n")).first()[0] or 0
    buckets = max(24, math.ceil(0.35 * total / POSTINGS_PER_BUCKET))
    classes = seen.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.count("*").alias("n_copies"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = materialise(sieve(docs, width, buckets), "shared")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) / 10))
    survivors = classes.join(shared, "h1").where(F.col("shared") >= least).select("node", "first_doc", "h1", "h2").where(F.col("first_doc").isNotNull())
    sets = materialise(blocks(docs, materialise(survivors, "survivors"), width), "sets")
    idx = materialise(index(sets, buckets), "index")
    spark, links, comps, most = docs.sparkSession, None, None, 0
    sweep(spark, since, seen, classes, idx)
    for turn in range(TURNS):  # only joins components early: whatever a turn leaves, the last step finds
        found = search(stars(idx, comps, turn), idx, "links")
        links = found if links is None else materialise(links.unionByName(found), "all-links")
        comps = components(links)
        sweep(spark, since, seen, classes, idx, links, comps)
    rest = recount(idx, comps)
    comps = components(links.unionByName(members(rest, opened(rest))))
    sweep(spark, since, seen, classes, comps)
    named = classes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named.select("h1", "h2", "n_copies", "component", "first_doc"), "named")
    first = F.min(F.when(F.col("first_doc").isNotNull(), F.struct("first_doc", "h1", "h2")))
    least_id = materialise(named.groupBy("component").agg(first.alias("f")), "least")
    # Classes without an id of their own stay alone: such a component has no name.
    mine = F.coalesce((F.col("f.h1") == F.col("h1")) & (F.col("f.h2") == F.col("h2")), F.lit(False))
    named = materialise(named.join(least_id, "component").select("h1", "h2", "n_copies", F.col("f.first_doc").alias("component_id"), mine.alias("names")), "named")
    out = seen.join(named, ["h1", "h2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("names", F.lit(True)).alias("names"))


def link(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links) and n_copies (documents of the same words)."""
    return _linked(docs, width).select("doc_id", "n_shingles", "component_id", "n_copies")


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One document of each component, as it was: a row of its least id, and of the text by which it has that id.  Documents
    without words stay (repeated rows once), and those without an id."""
    kept = _linked(docs, width).where("names AND doc_id = component_id").groupBy("doc_id", "component_id", "n_shingles").agg(F.min("t").alias("t"))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("t").alias("kept_t")).distinct()
    mark = unused(docs, "text_hash")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    named = marked.join(kept, (marked["doc_id"] == kept["kept_id"]) & (marked[mark] == kept["kept_t"]), "left_semi")
    return named.dropDuplicates(["doc_id", mark]).drop(mark).unionByName(docs.where(F.col("doc_id").isNull()))
