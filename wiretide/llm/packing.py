"""Best-fit packing by a grouping genetic algorithm.

Documents are cut only where longer than a sequence.  Full pieces are sequences by themselves; what remains is one item
for each document.  Items are dealt into groups of a bounded size.  On each group several islands evolve packings:
crossover injects whole well-filled bins of one parent into the other, drops the bins that then hold an item twice and
puts displaced items back, first in exchange where that fills a bin better, then by best fit in decreasing order; after
each epoch an island's elite moves to the next island.  An island stops at the bound that no packing can pass, and an epoch
when its best has not improved for a while.
The best packing of a group wins.  Bins left with room are then packed once more across groups.

Cases: null text is an empty document (its end token alone).  Equal lengths are ordered by row, so repeated rows and
repeated ids are packed as separate documents.  No documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialise

CAPACITY, END_ID = 1024, 2
PATIENCE = 12  # generations without a better best after which an epoch ends


def best_fit(bins: list[list[int]], room: list[int], items: list[int], size, capacity: int) -> None:
    """Put items (largest first) into the bins with least sufficient room; opens bins as needed.  In place."""
    by_room: dict[int, list[int]] = {}
    for b, r in enumerate(room):
        by_room.setdefault(r, []).append(b)
    mask = 0
    for r in by_room:
        mask |= 1 << r
    for i in items:
        s = size[i]
        above = mask >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        r -= s
        room[b] = r
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return len(room), -sum((capacity - r) ** 2 for r in room)


def load(bins: list[list[int]], size) -> list[int]:
    return [sum(size[i] for i in x) for x in bins]


def put_back(bins: list[list[int]], items: list[int], size, capacity: int) -> list[list[int]]:
    """Displaced items: first each bin with room changes an item for a displaced one that fills it better, then the rest go
    in by best fit, largest first.  In place."""
    room = [capacity - x for x in load(bins, size)]
    spare = sorted(items, key=lambda i: (size[i], i))
    sizes = [size[i] for i in spare]
    for b in sorted((b for b, r in enumerate(room) if r), key=lambda b: room[b]):
        best = (0, 0, 0)
        for at, i in enumerate(bins[b]):
            j = bisect_right(sizes, size[i] + room[b]) - 1
            if j >= 0 and sizes[j] - size[i] > best[0]:
                best = (sizes[j] - size[i], at, j)
        gain, at, j = best
        if gain:
            out, bins[b][at] = bins[b][at], spare[j]
            room[b] -= gain
            del spare[j], sizes[j]
            k = bisect_right(sizes, size[out])
            spare.insert(k, out)
            sizes.insert(k, size[out])
    best_fit(bins, room, spare[::-1], size, capacity)
    return bins


def crossover(a: list[list[int]], b: list[list[int]], size, capacity: int, rng) -> list[list[int]]:
    filled = load(b, size)
    full = sorted(range(len(b)), key=lambda k: (filled[k], k), reverse=True)
    take = [b[k] for k in full[: max(1, len(full) // 2)] if rng.random() < 0.5]
    inside = {i for x in take for i in x}
    bins, displaced = [list(x) for x in take], []
    for x in a:
        if inside.isdisjoint(x):
            bins.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    return put_back(bins, displaced, size, capacity)


def mutate(bins: list[list[int]], size, capacity: int, rng) -> list[list[int]]:
    """Empty the emptiest bins and a few others, and put their items back."""
    filled = load(bins, size)
    order = sorted(range(len(bins)), key=lambda k: (filled[k], k))
    few = max(2, min(12, len(bins) // 20))
    drop = set(order[: rng.randint(1, few)]) | {rng.randrange(len(bins)) for _ in range(rng.randint(1, few))}
    kept = [list(x) for k, x in enumerate(bins) if k not in drop]
    return put_back(kept, [i for k in drop for i in bins[k]], size, capacity)


def evolve(size: list[int], elites: list[list[list[int]]], island: int, epoch: int, capacity: int, population: int, generations: int) -> list[list[int]]:
    """One island's epoch over items in descending order of size; gives its best packing.

    Exactly full bins of its best packing rest, but for as many as there are others, which are drawn anew each epoch; the
    packings evolve over what is left.  Stops where no packing can be better."""
    rng = random.Random(f"{island} {epoch} {len(size)} {sum(size)}")
    least = math.ceil(sum(size) / capacity)
    score = lambda bins: fitness([capacity - x for x in load(bins, size)], capacity)
    if not elites:
        bins: list[list[int]] = []
        best_fit(bins, [], list(range(len(size))), size, capacity)
        elites = [bins]
    best = min(elites, key=score)
    if len(best) <= least:
        return best
    filled = load(best, size)
    full = [x for x, f in zip(best, filled, strict=True) if f == capacity]
    rng.shuffle(full)
    others = len(best) - len(full)
    resting = full[max(20, others) :]
    still = {i for x in resting for i in x}
    free = [i for i in range(len(size)) if i not in still]
    bound = math.ceil(sum(size[i] for i in free) / capacity)

    def member(bins):  # an elite over the free items alone
        whole = [list(x) for x in bins if still.isdisjoint(x)]
        return put_back(whole, [i for x in bins if not still.isdisjoint(x) for i in x if i not in still], size, capacity)

    pop = [(score(m), m) for m in map(member, elites)]
    while len(pop) < population:
        order = sorted(free, key=lambda i: -size[i] * rng.uniform(0.7, 1))
        bins = []
        best_fit(bins, [], order, size, capacity)
        pop.append((score(bins), bins))
    idle = 0
    for _ in range(generations):
        pop.sort(key=lambda p: p[0])
        if pop[0][0][0] <= bound or idle >= PATIENCE:
            break
        a, b = sorted(rng.sample(range(len(pop)), 2))
        child = pop[a][1] if rng.random() < 0.4 else crossover(pop[a][1], pop[b][1], size, capacity, rng)
        child = mutate(child, size, capacity, rng)
        s = score(child)
        idle = 0 if s < pop[0][0] else idle + 1
        if s < pop[-1][0] and all(s != p[0] for p in pop):  # no twins
            pop[-1] = (s, child)
    return resting + min(pop, key=lambda p: p[0])[1]


def pack_items(items: DataFrame, capacity: int, group_size: int, islands: int, epochs: int, population: int, generations: int, label: str) -> DataFrame:
    """items (with columns row and length) plus grp, bin and offset.  A group never has more than about group_size items."""
    spark = items.sparkSession
    n = items.count()
    groups = max(1, math.ceil(n / group_size))
    items = items.withColumn("grp", F.pmod("row", F.lit(groups)).cast("int"))
    columns = [f.name for f in items.schema.fields]

    def describe(part):  # one row for each group: the sizes in descending order
        import numpy as np
        import pandas as pd

        size = np.sort(part["length"].to_numpy())[::-1].astype("<i4")
        return pd.DataFrame({"grp": [part["grp"].iloc[0]], "sizes": [size.tobytes()]})

    sizes = items.select("grp", "length").groupBy("grp").applyInPandas(describe, "grp int, sizes binary")
    state = sizes.select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.array().cast("array<binary>").alias("elites"))

    def run(epoch: int):
        def on_islands(batches: Iterator) -> Iterator:
            import numpy as np
            import pandas as pd

            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    size = np.frombuffer(r.sizes, dtype="<i4").tolist()
                    elites = []
                    for e in r.elites:
                        where = np.frombuffer(e, dtype="<i4")
                        order = np.argsort(where, kind="stable")
                        elites.append([x.tolist() for x in np.split(order, np.flatnonzero(np.diff(where[order])) + 1)])
                    bins = evolve(size, elites, r.island, epoch, capacity, population, generations)
                    where = np.empty(len(size), dtype="<i4")
                    for b, x in enumerate(bins):
                        where[x] = b
                    rows.append((r.grp, r.island, r.sizes, where.tobytes(), len(bins)))
                yield pd.DataFrame(rows, columns=["grp", "island", "sizes", "elite", "n_bins"])

        return on_islands

    for epoch in range(epochs):
        tasks = max(1, min(groups * islands, 4 * spark.sparkContext.defaultParallelism))
        best = state.repartition(tasks, "grp", "island").mapInPandas(run(epoch), "grp int, island int, sizes binary, elite binary, n_bins int")
        best = materialise(best, f"{label}-epoch{epoch}")
        if epoch < epochs - 1:  # each island keeps its elite and gets its neighbour's
            moved = best.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
            state = best.join(moved, ["grp", "island"]).select("grp", "island", "sizes", F.array("elite", "guest").alias("elites"))
    winner = best.groupBy("grp").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("elite"))

    def place(key, rows, won):
        import numpy as np

        rows = rows.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        rows["bin"] = np.frombuffer(won["elite"].iloc[0], dtype="<i4").astype("int64")
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        return rows[[*columns, "bin", "offset"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields) + ", bin long, offset long"
    return items.groupBy("grp").cogroup(winner.groupBy("grp")).applyInPandas(place, schema)


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    files: tuple[str, str, str] | None = None,
    group_size: int = 8192,
    islands: int = 3,
    epochs: int = 3,
    population: int = 8,
    generations: int = 60,
    loose_below: float = 0.98,
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    row = F.monotonically_increasing_id()
    cut = materialise(tokens.pieces(docs, capacity, end_id, files), "pieces").withColumn("row", row)
    done = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    options = (capacity, group_size, islands, epochs, population, generations)
    first = materialise(pack_items(cut.where(F.col("length") < capacity), *options, "pack"), "packed")
    # Bins with room, of all groups together: the waste of each group's last bins would otherwise add up.
    filled = first.groupBy("grp", "bin").agg(F.sum("length").alias("filled"))
    first = first.join(filled, ["grp", "bin"])
    tight = first.where(F.col("filled") >= loose_below * capacity)
    loose = materialise(first.where(F.col("filled") < loose_below * capacity).select("doc_id", "piece", "start", "length", "ids_crc32"), "loose")
    again = pack_items(loose.withColumn("row", row), *options, "repack")
    number = lambda odd: F.shiftleft(F.col("grp").cast("long"), 24) * 2 + F.col("bin") * 2 + odd
    parts = [whole, tight.withColumn("sequence_id", number(0)), again.withColumn("sequence_id", number(1))]
    return parts[0].select(*done).unionByName(parts[1].select(*done)).unionByName(parts[2].select(*done))
