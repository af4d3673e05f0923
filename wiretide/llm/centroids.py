"""Centroid clustering: plain Lloyd over integer vectors, exact at every step.

A vector's components become integers floor(scale * x).  The driver holds the centroids (``k`` of ``dims`` integers, a
size that no table changes) and sends them with each pass; mapInPandas computes the squared differences to one centroid
after another in NumPy and takes the lowest number among the nearest.  A pass ends with one sum for each cluster and
partition; a groupBy adds these.  All sums are integers, so the result depends neither on partitions nor on their order.

Components below 2^27 are computed as 64-bit integers, which cannot overflow here; larger ones (any finite double) as
Python's unbounded integers, row by row where they occur.  Sums travel as digits to the base 2^32 for the same reason.

Cases: rows whose vector is null, has another length than ``dims`` or holds null or non-finite components take no part and
are not in the result.  A vector starts as a centroid by the hash of its id; of rows with one id (or with a null id, which
come last) the smaller vector goes first, and repeated rows are separate vectors.  Fewer than ``k`` vectors start as many
centroids; an empty table gives an empty result.  Distances and inertias beyond a long are null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pick

SAFE, DIGIT = 1 << 27, 32
LONG = (1 << 63) - 1


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return pick(vectors, "vec_id", "embedding").where(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("embedding"))


def first_centroids(rows: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The integer vectors of the k rows whose ids have the smallest hashes."""
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    taken = rows.orderBy(at.asc_nulls_last(), "embedding").select("embedding").limit(k).collect()
    return [[whole(x, scale) for x in r[0]] for r in taken]


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly (beyond 2^53 a double is an integer already)."""
    return math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale


def integers(v, scale: int):
    """The vectors as 64-bit integers, and which rows these hold; the others' components as Python's integers."""
    import numpy as np

    small = (np.abs(v) < SAFE // scale).all(axis=1)
    near = np.floor(np.where(small[:, None], v, 0.0) * scale).astype(np.int64)
    far = np.array([[whole(x, scale) for x in row] for row in v[~small].tolist()], dtype=object).reshape(-1, v.shape[1])
    return near, small, far


def assign(near, small, far, centroids: list[list[int]]):
    """Number and squared distance of each vector's nearest centroid (distances as Python's integers where any is large)."""
    import numpy as np

    modest = [all(abs(x) <= SAFE for x in c) for c in centroids]
    wide = not (small.all() and all(modest))
    best = np.full(len(near), -1, dtype=np.int64)
    least = np.zeros(len(near), dtype=object if wide else np.int64)
    for number, c in enumerate(centroids):
        if modest[number]:
            off = near - np.array(c, dtype=np.int64)
            d = np.einsum("ij,ij->i", off, off)
        else:
            d = ((near.astype(object) - np.array(c, dtype=object)) ** 2).sum(axis=1)
        if wide:
            d = d.astype(object)
            d[~small] = ((far - np.array(c, dtype=object)) ** 2).sum(axis=1)
        better = ((best < 0) | (d < least)).astype(bool)
        best[better], least[better] = number, d[better]
    return best, least


def batches(parts, scale: int) -> Iterator[tuple]:
    """The integer vectors of each batch of rows, with the batch."""
    import numpy as np

    for rows in parts:
        if len(rows):
            yield rows, *integers(np.stack(rows["embedding"].to_numpy()).astype(np.float64), scale)


def digits(x: int) -> list[int]:
    """x to the base 2^32, lowest first; each digit has x's sign."""
    out, left = [], abs(x)
    while left or not out:
        out.append((left & ((1 << DIGIT) - 1)) * (1 if x >= 0 else -1))
        left >>= DIGIT
    return out


def sums_of(centroids: list[list[int]], scale: int) -> Callable:
    """A pass over a partition: for each cluster with rows, their number and the digits of the sums of their components."""

    def run(parts):
        import numpy as np
        import pandas as pd

        dims = len(centroids[0])
        count, total = [0] * len(centroids), [np.zeros(dims, dtype=object) for _ in centroids]
        for _, near, small, far in batches(parts, scale):
            best, _ = assign(near, small, far, centroids)
            for c in np.unique(best):
                mine = best == c
                count[c] += int(mine.sum())
                total[c] += near[mine & small].sum(axis=0).astype(object)
                if not small.all():
                    total[c] += far[best[~small] == c].sum(axis=0)
        out = []
        for c, n in enumerate(count):
            if n:
                each = [digits(int(x)) for x in total[c]]
                for place in range(max(map(len, each))):
                    out.append((c, place, n if place == 0 else 0, [d[place] if place < len(d) else 0 for d in each]))
        yield pd.DataFrame(out, columns=["cluster", "place", "n", "sums"])

    return run


def moved(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round; one without vectors stays."""
    dims = len(centroids[0])
    parts = rows.mapInPandas(sums_of(centroids, scale), "cluster int, place int, n long, sums array<long>")
    sums = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)]
    n, total = [0] * len(centroids), [[0] * dims for _ in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), *sums).collect():
        n[r.cluster] += r.n
        for d in range(dims):
            total[r.cluster][d] += r[d + 3] << (DIGIT * r.place)
    return [[x // n[c] for x in total[c]] if n[c] else own for c, own in enumerate(centroids)]


def labelled(centroids: list[list[int]], scale: int) -> Callable:
    """A pass that gives each vector's cluster and squared distance."""

    def run(parts):
        import pandas as pd

        for rows, near, small, far in batches(parts, scale):
            best, least = assign(near, small, far, centroids)
            fits = pd.array([int(x) if x <= LONG else None for x in least] if least.dtype == object else least, dtype="Int64")
            yield pd.DataFrame({"vec_id": rows["vec_id"].to_numpy(), "cluster": best.astype("int32"), "distance": fits})

    return run


def total_of(distance: Column) -> Column:
    """Sum of distances as a long; null where a distance or the sum exceeds one."""
    kept = F.count(distance) == F.count(F.lit(1))
    return F.when(kept, F.sum(distance.cast("decimal(38,0)")).try_cast("long"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """One row for each usable vector: its cluster after ``rounds`` rounds, the squared distance and the inertias."""
    spark = vectors.sparkSession
    rows = usable(vectors, dims)
    centroids = first_centroids(rows, k, scale, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = materialise(rows.mapInPandas(labelled(centroids, scale), f"vec_id {kind}, cluster int, distance long"), "clusters")
    each = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(total_of(F.col("distance")).alias("inertia")).collect()}
    known = [x for x in each.values() if x is not None]
    inertia = sum(known) if len(known) == len(each) and sum(known) <= LONG else None
    facts = [(c, each[c], inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(each)]
    at = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(at, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
