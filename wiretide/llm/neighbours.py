"""Nearest neighbours by largest inner product, from vantage-point trees.

A vector v gets one more component, sqrt(R^2 - |v|^2) with R the largest norm (one aggregate over all rows); queries get
zero there.  Then |q - v|^2 = |q|^2 + R^2 - 2 q.v, so the nearest by distance is the largest by inner product, and the
triangle inequality holds.

Rows are dealt into shards by space: to the nearest of at most PIVOTS pivots, taken from a sample of at most SAMPLE rows
and moved to the means of what is nearest; a pivot with more than ``shard_rows`` rows has several shards.  Each shard's
tree is built once and kept as one row.  A query first searches the shards of its own pivot; the k-th distance found there
then prunes whole pivots by their radius, and it searches the rest.  A branch (or pivot) is pruned where its lower bound
on the distance, times ``factor``, exceeds the k-th distance so far (with a margin for rounding): 1 is exact, more prunes
earlier.  Rows of equal vectors share one leaf entry.  Only ids and scores leave a search.

Cases: vectors that are null, all zero, or with null or non-finite components take no part as rows or queries, nor do
vectors whose length differs from ``dims`` (unless given the most frequent length, of equally frequent ones the largest).
Ties go to the smaller id.  Fewer than k candidates give fewer rows.  Repeated ids are separate rows; a query never finds
its own id; a repeated query row (of the same id and vector) is asked once.  No vectors, or none that is a query, give no
rows; extra columns are ignored.  Any finite components will do: where squares or products could leave the range of doubles,
trees and bounds work on vectors scaled by a power of two, and scores on the vectors as they are; a score that is no number
(an infinity less another) counts as minus infinity.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pick, sweep, written

LEAF, TOGETHER = 64, 256
PIVOTS, SAMPLE = 256, 20_000
BLOCK_ROWS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def lift(v, radius: float):
    """Rows with their further component."""
    import numpy as np

    return np.concatenate([v, np.sqrt(np.maximum(0, radius**2 - np.einsum("ij,ij->i", v, v)))[:, None]], axis=1)


def exact(q, v):
    """Inner products of paired rows, summed in the order of the components."""
    import numpy as np

    s = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(q.shape[1]):
            s += q[:, d] * v[:, d]
    return np.where(np.isnan(s), -np.inf, s)


def scale_of(largest: float, smallest: float) -> float:
    """1 where squares and products of components stay in range; else the power of two that takes the largest below 1."""
    if largest < 2.0**400 and smallest > 2.0**-400:
        return 1.0
    return math.ldexp(1.0, -math.frexp(largest)[1])


class Tree:
    """A vantage-point tree over the distinct vectors of a shard, visited for many queries at once."""

    def __init__(self, v, ids, radius: float, k: int, scale: float = 1.0) -> None:
        import numpy as np

        order = np.argsort(ids, kind="stable")
        v, ids = v[order], ids[order]
        _, first, which = np.unique(v, axis=0, return_index=True, return_inverse=True)
        # Distinct vectors, numbered by smallest id; each keeps its k smallest ids whichever id is the query's own.
        order = np.argsort(first, kind="stable")
        number = np.empty(len(order), dtype=int)
        number[order] = np.arange(len(order))
        which = number[which.ravel()]
        by = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[by], np.arange(len(order) + 1))
        self.members = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = ids[by[a:b]]
            self.members.append(own[: k + int(np.unique(own, return_counts=True)[1].max())] if len(own) > k else own)
        v = v[first[order]]
        self.x, self.radius, self.scored = lift(v * scale, radius), radius, 0
        self.scale, self.plain = scale, None if scale == 1 else v  # what scores are taken from
        self.root = self.build(np.arange(len(self.x)))

    def packed(self) -> bytes:
        return pickle.dumps(self.__dict__, protocol=5)

    @classmethod
    def unpacked(cls, raw: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(pickle.loads(raw))
        return tree

    def build(self, at):
        import numpy as np

        if len(at) <= LEAF:
            return at
        # The vantage point: the row farthest from the first row, which spreads distances.
        first = self.x[at] - self.x[at[0]]
        point = int(at[int(np.argmax(np.einsum("ij,ij->i", first, first)))])
        diff = self.x[at] - self.x[point]
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        near, far = order[:half], order[half:]
        return point, (d[near[0]], d[near[-1]]), (d[far[0]], d[far[-1]]), self.build(at[near]), self.build(at[far])

    def search(self, q, k: int, factor: float, floor=None):
        """For each query: the rows of its k best by inner product, as far as the pruning lets them be found, -1 where there
        are fewer; ``floor``: inner products that k other rows are known to reach."""
        import numpy as np

        norms = np.einsum("ij,ij->i", q, q)
        best = np.full((len(q), k), -np.inf)
        rows = np.full((len(q), k), -1)
        floor = np.full(len(q), -np.inf) if floor is None else floor
        margin = 1e-9 * (1 + self.radius)

        def open_to(who, bound):
            known = np.maximum(best[who, -1], floor[who])
            limit = np.sqrt(np.maximum(0, norms[who] + self.radius**2 - 2 * np.where(np.isfinite(known), known, 0)))
            return who[(bound * factor <= limit + margin) | ~np.isfinite(known)]

        def visit(node, who) -> None:
            if not len(who):
                return
            if not isinstance(node, tuple):
                self.scored += len(who) * len(node)
                s = q[who] @ self.x[node][:, :-1].T
                some = np.flatnonzero(s.max(axis=1) >= best[who, -1])  # only these have anything better, or a tie
                who, s = who[some], s[some]
                both = np.concatenate([best[who], s], axis=1)
                name = np.concatenate([rows[who], np.broadcast_to(node, s.shape)], axis=1)
                # Rows are numbered by smallest id, which decides ties.
                order = np.lexsort((name, -both), axis=1)[:, :k]
                best[who] = np.take_along_axis(both, order, axis=1)
                rows[who] = np.take_along_axis(name, order, axis=1)
                return
            point, inner, outer, near, far = node
            v = self.x[point]
            d = np.sqrt(np.maximum(0, norms[who] + v @ v - 2 * (q[who] @ v[:-1])))

            def lower(span):
                return np.maximum(0, np.maximum(span[0] - d, d - span[1]))

            a, b = lower(inner), lower(outer)
            first = (a < b) | ((a == b) & (d <= (inner[1] + outer[0]) / 2))
            if len(who) < TOGETHER:  # few queries go the way that most of them prefer
                first = np.full(len(who), 2 * np.count_nonzero(first) >= len(who))
            for nodes, mine in (((near, a), (far, b)), first), (((far, b), (near, a)), ~first):
                for n, bound in nodes:
                    visit(n, open_to(who[mine], bound[mine]))

        visit(self.root, np.arange(len(q)))
        return rows

    def answers(self, ids, q, k: int, factor: float, floor=None):
        """(query's place, vec_id, score) of the k best candidates of each query, its own id left out."""
        import numpy as np

        with np.errstate(over="ignore"):
            found = self.search(q * self.scale, k + 1, factor, None if floor is None else floor * self.scale * self.scale)
        who, at = np.nonzero(found >= 0)
        row = found[who, at]
        score = exact(q[who], self.x[row][:, :-1] if self.plain is None else self.plain[row])
        out = []
        lens = np.array([len(self.members[r]) for r in row], dtype=int)
        who, score = np.repeat(who, lens), np.repeat(score, lens)
        name = np.concatenate([self.members[r] for r in row]) if len(row) else np.zeros(0, dtype=np.int64)
        ok = name != ids[who]
        if floor is not None:
            ok &= score >= floor[who] - np.where(np.isfinite(floor[who]), 1e-9 * (1 + np.abs(floor[who])), 0)
        who, name, score = who[ok], name[ok], score[ok]
        order = np.lexsort((name, -score, who))
        who, name, score = who[order], name[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        out = place < k
        return who[out], name[out], score[out]


def pivots(rows: DataFrame, n: int, radius: float, shard_rows: int, scale: float = 1.0):
    """Lifted points, one for each shard_rows rows or PIVOTS: a bounded sample's k-means, from a farthest-first start."""
    import numpy as np

    want = min(PIVOTS, max(1, math.ceil(n / shard_rows)))
    sample = rows.where(F.rand(seed=5) < min(1.0, 2 * SAMPLE / max(n, 1))).select("v").limit(SAMPLE).collect() or rows.select("v").limit(1).collect()
    x = lift(np.array([r["v"] for r in sample]) * scale, radius)
    x = x[np.lexsort(x.T[::-1])]
    centres, far = [x[0]], np.full(len(x), np.inf)
    while len(centres) < min(want, len(x)):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres.append(x[int(np.argmax(far))])
    c = np.array(centres)
    for _ in range(8):
        near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def search(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    factor: float = 2.0,
    shard_rows: int = 20_000,
    block_rows: int = BLOCK_ROWS,
    dims: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by ``every``) against all rows but their own."""
    spark = vectors.sparkSession
    since = len(written(spark))
    result = "query_id long, rank int, vec_id long, score double"
    rows = materialise(usable(vectors), "vectors")
    if not dims:
        usual = rows.groupBy(F.size("v").alias("dims")).count().agg(F.max(F.struct("count", "dims")).alias("m")).first()["m"]
        dims = usual["dims"] if usual else 0
    rows = rows.where(F.size("v") == dims)
    sizes = F.transform("v", lambda x: F.abs(x))
    asks = F.col("vec_id") % every == 0
    facts = rows.agg(F.count("*").alias("n"), F.max(F.array_max(sizes)).alias("largest"), F.min(F.array_min(F.filter(sizes, lambda x: x > 0))).alias("smallest"), F.count(F.when(asks, 1)).alias("q")).first()
    if not facts["q"]:
        return spark.createDataFrame([], result)
    scale = scale_of(facts["largest"], facts["smallest"])
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale))
    radius = math.sqrt(rows.agg(F.max(norm2)).first()[0])
    points = pivots(rows, facts["n"], radius, shard_rows, scale)

    def near(frames: Iterator) -> Iterator:
        """The nearest pivot of each row, and its distance."""
        import numpy as np

        for pdf in frames:
            x = lift(np.array(pdf["v"].tolist()) * scale, radius) if len(pdf) else np.zeros((0, points.shape[1]))
            d = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * x @ points.T
            at = np.argmin(d, axis=1)
            yield pdf.assign(pivot=at.astype("int32"), far=np.sqrt(np.maximum(0, d[np.arange(len(x)), at])))

    placed = materialise(rows.mapInPandas(near, "vec_id long, v array<double>, pivot int, far double"), "placed")
    cells = {r["pivot"]: (r["n"], r["far"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most PIVOTS
    parts = [max(1, math.ceil(cells.get(p, (0, 0))[0] / shard_rows)) for p in range(len(points))]
    reach = [cells.get(p, (0, -math.inf))[1] for p in range(len(points))]
    part = F.pmod(F.xxhash64("vec_id", "v"), F.element_at(F.lit(parts), F.col("pivot") + 1)).cast("int")

    def grow(key, pdf):
        import numpy as np
        import pandas as pd

        tree = Tree(np.array(pdf["v"].tolist()), pdf["vec_id"].to_numpy(), radius, k, scale)
        return pd.DataFrame({"pivot": [key[0]], "part": [key[1]], "tree": [tree.packed()]})

    trees = materialise(placed.select("vec_id", "v", "pivot", part.alias("part")).groupBy("pivot", "part").applyInPandas(grow, "pivot int, part int, tree binary"), "trees")
    queries = materialise(placed.where(asks).select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("mark"), F.col("pivot").alias("home")).dropDuplicates(["query_id", "mark"]), "queries")

    def ask(asked: DataFrame, label: str) -> DataFrame:
        """(query_id, mark, vec_id, score) of queries in their cells: asked has query_id, mark, v, floor and pivot."""
        # The queries of a shard are dealt into blocks of a bounded size; each block gets the shard's tree.
        counts = asked.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        counts = materialise(counts, "blocks")  # at most PIVOTS rows
        left = asked.join(F.broadcast(counts), "pivot").select("query_id", "mark", "v", "floor", "pivot", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(F.lit(parts), F.col("pivot") + 1) - 1)))
        right = trees.join(F.broadcast(counts), "pivot").select(F.col("pivot").alias("p"), F.col("part").alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "tree")

        def cell(q, shard):
            import numpy as np
            import pandas as pd

            if not len(q) or not len(shard):
                return pd.DataFrame({"query_id": [], "mark": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "mark": "int64", "vec_id": "int64"})
            tree, ids = Tree.unpacked(shard["tree"].iloc[0]), q["query_id"].to_numpy()
            who, name, score = tree.answers(ids, np.array(q["v"].tolist()), k, factor, q["floor"].fillna(-np.inf).to_numpy())
            return pd.DataFrame({"query_id": ids[who], "mark": q["mark"].to_numpy()[who], "vec_id": name, "score": score})

        found = left.groupBy("pivot", "part", "block").cogroup(right.groupBy("p", "s", "b")).applyInPandas(cell, "query_id long, mark long, vec_id long, score double")
        return materialise(best(found), label)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    home = ask(queries.select("query_id", "mark", "v", F.lit(None).cast("double").alias("floor"), F.col("home").alias("pivot")), "home")
    floors = home.where(F.col("rank") == k).select("query_id", "mark", F.col("score").alias("floor"))

    def further(frames: Iterator) -> Iterator:
        """A row for each other pivot that the query's k-th distance cannot rule out."""
        import numpy as np
        import pandas as pd

        for pdf in frames:
            if not len(pdf):
                continue
            v, told = np.array(pdf["v"].tolist()), pdf["floor"].fillna(-np.inf).to_numpy()
            near, floor = v * scale, told * scale * scale
            norms = (near**2).sum(axis=1)
            d = np.sqrt(np.maximum(0, norms[:, None] + (points**2).sum(axis=1) - 2 * near @ points[:, :-1].T))
            limit = np.where(np.isfinite(floor), np.sqrt(np.maximum(0, norms + radius**2 - 2 * np.where(np.isfinite(floor), floor, 0))), np.inf)
            ok = np.maximum(0, d - np.array(reach)) * factor <= (limit + 1e-9 * (1 + radius))[:, None]
            ok &= np.isfinite(reach) & (np.arange(len(points)) != pdf["home"].to_numpy()[:, None])
            who, pivot = np.nonzero(ok)
            yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[who], "mark": pdf["mark"].to_numpy()[who], "v": pd.Series([v[w] for w in who], dtype=object), "floor": np.where(np.isfinite(told), told, np.nan)[who], "pivot": pivot.astype("int32")})

    rest = queries.join(floors, ["query_id", "mark"], "left").select("query_id", "mark", "v", "floor", "home")
    more = ask(materialise(rest.mapInPandas(further, "query_id long, mark long, v array<double>, floor double, pivot int"), "further"), "more")
    out = materialise(best(home.drop("rank").unionByName(more.drop("rank"))).select("query_id", "rank", "vec_id", "score"), "nearest")
    sweep(spark, since, out)
    return out
