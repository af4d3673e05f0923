"""Statistical outliers among flows: robust z-scores, an isolation forest, and their explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import storage

# The features, of which the first group enters by its logarithm.
LOG_FEATURES = ("bytes_sent", "bytes_received", "packets_sent", "packets_received", "duration_seconds", "packets_per_second", "dns_query_count")
RAW_FEATURES = ("avg_packet_size", "bytes_ratio", "payload_entropy", "interval_dispersion", "unique_dst_ports", "longest_dns_label")
SIGMA, CONSTANT_Z = 1.4826, 99.0


def features(flows: DataFrame) -> tuple[DataFrame, list[str]]:
    """session_id, flow_id and the features that the flows have, nulls as 0."""
    cols = {c: F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in LOG_FEATURES if c in flows.columns}
    cols |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in RAW_FEATURES if c in flows.columns}
    return flows.select("session_id", "flow_id", *[v.alias(k) for k, v in cols.items()]), list(cols)


def medians(f: DataFrame, names: list[str], by: str, accuracy: int = 10_000) -> DataFrame:
    """by and m_<name>: exact medians of several columns, no group of which is ever one task's work.

    One pass sketches each column of each group (percentile_approx: bounded memory, merged from partial sketches) between
    two ranks that enclose the middle by more than the sketch's error.  A second counts what lies below the bracket and, by
    value, what lies in it: four parts in ``accuracy`` of the rows, of which equal values are one row.  The middle ranks are
    then picked among these.  Nulls and NaN do not count; a column of nulls has a null median."""
    off = 2.0 / accuracy
    clean = f.select(by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in names])
    brackets = clean.groupBy(by).agg(*[F.percentile_approx(c, [0.5 - off, 0.5 + off], accuracy).alias(f"b_{c}") for c in names], *[F.count(c).alias(f"n_{c}") for c in names])
    brackets = storage.stored(brackets, "brackets")  # a row for each group
    joined = clean.join(brackets, by)
    lo, hi = (lambda c: F.get(f"b_{c}", F.lit(0))), (lambda c: F.get(f"b_{c}", F.lit(1)))
    below = joined.groupBy(by).agg(*[F.count(F.when(F.col(c) < lo(c), 1)).alias(c) for c in names])
    below = below.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("below")) for c in names])).alias("s")).select(by, "s.*")
    sizes = brackets.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n")) for c in names])).alias("s")).select(by, "s.*")
    inside = F.array_compact(F.array(*[F.when(F.col(c).between(lo(c), hi(c)), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in names]))
    values = joined.select(by, F.explode(inside).alias("s")).select(by, "s.*").groupBy(by, "column", "value").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(by, "column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    v = values.withColumn("upto", upto).join(below, [by, "column"]).join(sizes, [by, "column"])
    end = F.col("below") + F.col("upto")
    held = lambda rank: F.min(F.when(end > rank, F.col("value")))
    middle = v.groupBy(by, "column").agg(((held(F.floor((F.col("n") - 1) / 2)) + held(F.floor(F.col("n") / 2))) / 2).alias("m"))
    return brackets.select(by).join(middle.groupBy(by).agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"m_{c}") for c in names]), by, "left")


def centres(f: DataFrame, names: list[str]) -> DataFrame:
    """session_id and the median (m_<name>), MAD (a_<name>) and deviation (s_<name>) of each feature.

    Stored, a row for each session: the joins of the flows with it then need no exchange of the flows, which a session's
    number would deal to a few tasks."""
    spread = f.groupBy("session_id").agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    m = storage.stored(medians(f, names, "session_id").join(spread, "session_id"), "centres")
    off = f.join(m, "session_id").select("session_id", *[F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])
    mad = medians(off, names, "session_id").select("session_id", *[(F.col(f"m_{c}") * SIGMA).alias(f"a_{c}") for c in names])
    return storage.stored(m.join(mad, "session_id"), "spreads")


def z_scores(f: DataFrame, at: DataFrame, names: list[str]) -> DataFrame:
    """f with z in place of each feature: from median and MAD; from the deviation where the MAD is 0; capped where the
    feature is constant.  at: as ``centres`` gives it."""

    def z(c):
        off = F.col(c) - F.col(f"m_{c}")
        spread = F.when(F.col(f"a_{c}") < 1e-9, F.col(f"s_{c}")).otherwise(F.col(f"a_{c}"))
        return F.when(spread < 1e-9, F.when(off == 0, 0.0).otherwise(F.signum(off) * CONSTANT_Z)).otherwise(off / spread)

    return f.join(at, "session_id").select(*[c for c in f.columns if c not in names], *[z(c).alias(c) for c in names])


def robust_z(f: DataFrame, names: list[str]) -> DataFrame:
    """z of each feature among all flows of its session."""
    f = storage.stored(f.select("session_id", "flow_id", *names), "features")
    return z_scores(f, centres(f, names), names)


def explain(z: DataFrame, names: list[str], bar: float = 2.0) -> DataFrame:
    """The features that stand out, strongest first."""
    each = F.array(*[F.struct((-F.abs(c)).alias("k"), F.lit(c).alias("feature"), F.round(F.col(c), 2).alias("z")) for c in names])
    return z.withColumn("reasons", F.transform(F.array_sort(F.filter(each, lambda x: x.k <= -bar)), lambda x: F.struct(x.feature.alias("feature"), x.z.alias("z"))))


def isolation_scores(f: DataFrame, names: list[str], trees: int = 200, sample: int = 256, seed: int = 0) -> DataFrame:
    """f with a score in (0, 1): higher is easier to isolate.

    Each tree is grown on a sample of bounded size (of the flows with the least hashes of each of 16 shards), collected to
    the driver; scoring is a map over all flows, so its cost is linear and nothing is gathered.  Only flows with hashes so
    small that a shard has twice what it gives are ranked."""
    import numpy as np
    from pyspark.sql import functions as G

    counts = storage.stored(f.groupBy("session_id").agg(G.count("*").alias("n")), "counts")
    spark_sessions = [r["session_id"] for r in counts.select("session_id").collect()]
    forests = {}
    pool = min(trees * sample, 20_000)
    w = Window.partitionBy("session_id", "shard").orderBy("h", "flow_id")
    hashed = f.withColumn("h", G.xxhash64(G.lit(seed), "flow_id")).join(counts, "session_id").where((G.col("h") / 2.0**64 + 0.5) * G.col("n") <= 2 * pool)
    hashed = hashed.withColumn("shard", G.pmod("h", G.lit(16)))
    rows = hashed.withColumn("nth", G.row_number().over(w)).where(G.col("nth") <= pool // 16).select("session_id", "h", "flow_id", *names).collect()
    for s in spark_sessions:
        mine = sorted((r for r in rows if r["session_id"] == s), key=lambda r: (r["h"], r["flow_id"]))
        x = np.array([[r[c] for c in names] for r in mine], dtype=float)
        rng = np.random.default_rng([seed, int(s) & 0xFFFFFFFF])
        forests[s] = (min(sample, len(x)), *_flattened([_grow(x[rng.choice(len(x), min(sample, len(x)), replace=False)], rng) for _ in range(trees)], len(names)))

    def score(batches):
        import numpy as np

        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            out = np.zeros(len(pdf))
            for s in pdf["session_id"].unique():
                at = np.flatnonzero(pdf["session_id"] == s)
                n, cuts, flat = forests[s]
                for lo in range(0, len(at), BLOCK):  # what a block needs stays in the cache
                    mine = at[lo : lo + BLOCK]
                    out[mine] = 2.0 ** (-_mean_depth(x[mine], cuts, flat) / max(_average(n), 1e-9))
            yield pdf.assign(score=out)

    kinds = ", ".join(f"`{c}` double" for c in names)
    return f.select("session_id", "flow_id", *names).mapInPandas(score, f"session_id long, flow_id long, {kinds}, score double")


def _average(n: float) -> float:
    import math

    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x, rng, depth: int = 0, limit: int = 8):
    import numpy as np

    node = {"n": len(x)}
    wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth < limit else []
    if len(wide):
        c = int(rng.choice(wide))
        cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
        left = x[:, c] < cut
        node |= {"c": c, "cut": cut, "l": _grow(x[left], rng, depth + 1, limit), "r": _grow(x[~left], rng, depth + 1, limit)}
    return node


def _flattened(trees: list[dict], n_features: int):
    """The cuts of each feature over all trees, sorted, and each tree as arrays: depth, and by node its feature, the place
    of its cut among those of the feature, its left child (the right one follows it) and the path length if it is a leaf.

    A value is then looked up once among its feature's cuts, and trees compare small integers."""
    import numpy as np

    cuts: list[set] = [set() for _ in range(n_features)]
    listed = []
    for tree in trees:
        nodes, at, depth = [(tree, 0)], 0, 0
        left = []
        while at < len(nodes):
            node, level = nodes[at]
            depth = max(depth, level)
            if "c" in node:
                cuts[node["c"]].add(node["cut"])
                left.append(len(nodes))
                nodes += [(node["l"], level + 1), (node["r"], level + 1)]
            else:
                left.append(at)
            at += 1
        listed.append((depth, nodes, left))
    cuts = [np.array(sorted(c), dtype=float) for c in cuts]
    kind = np.uint16 if all(len(c) < 2**16 - 1 for c in cuts) else np.uint32
    flat = []
    for depth, nodes, left in listed:
        inner = ["c" in node for node, _ in nodes]
        feature = np.array([node.get("c", 0) for node, _ in nodes], dtype=np.intp)
        place = np.array([np.searchsorted(cuts[node["c"]], node["cut"]) if i else np.iinfo(kind).max for (node, _), i in zip(nodes, inner, strict=True)], dtype=kind)
        length = np.array([0.0 if i else level + _average(node["n"]) for (node, level), i in zip(nodes, inner, strict=True)])
        flat.append((depth, feature, place, np.array(left, dtype=np.intp), length))
    return cuts, flat


BLOCK = 8_192


def _mean_depth(x, cuts: list, flat: list):
    """Mean path length of each row of x over the trees.  A row goes right where its value is not below the cut, NaN too;
    at a leaf it stays."""
    import numpy as np

    kind = flat[0][2].dtype
    ranks = np.stack([np.searchsorted(c, x[:, k], side="right").astype(kind) for k, c in enumerate(cuts)], axis=1).ravel()
    first, total = np.arange(len(x), dtype=np.intp) * len(cuts), np.zeros(len(x))
    for depth, feature, place, left, length in flat:
        node = np.zeros(len(x), dtype=np.intp)
        for _ in range(depth):
            right = ranks.take(first + feature.take(node)) > place.take(node)
            node = left.take(node) + right
        total += length.take(node)
    return total / len(flat)


def outliers(flows: DataFrame, contamination: float = 0.02, least: int = 50, cap: int = 50) -> DataFrame:
    """Flows that the forest isolates and a feature explains: at most cap for each session of enough flows."""
    enough = storage.stored(flows.groupBy("session_id").count().where(F.col("count") >= least).select("session_id"), "enough")
    f, names = features(flows.join(enough, "session_id", "left_semi"))
    scored = storage.stored(isolation_scores(f, names), "scored")  # with its features: scores are computed once
    bar = storage.stored(scored.groupBy("session_id").agg(F.percentile_approx("score", F.lit(1 - contamination), F.lit(10_000)).alias("bar")), "bar")
    top = scored.join(bar, "session_id").where("score >= bar").drop("bar")
    out = explain(z_scores(top, centres(scored, names), names), names).select("session_id", "flow_id", "score", "reasons").where(F.size("reasons") > 0)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "flow_id"))).where(F.col("place") <= cap)


RULE = "ANOMALY_STATISTICAL"
LIMIT = "Learns what is ordinary in this capture. If the whole capture is malicious, nothing in it will look unusual."


def findings(flows: DataFrame, **options) -> DataFrame:
    """Outliers as findings: a lead, never above medium, with the features that stand out."""
    from ..functions import expressions as E
    from . import rules

    named = flows.select("session_id", "flow_id", E.initiator().alias("host"), E.peer().alias("peer"))
    g = storage.stored(outliers(flows, **options), "outliers").join(named, ["session_id", "flow_id"])  # few, so the flows stay where they are
    said = F.transform("reasons", lambda r: F.concat(r.feature, F.when(r.z > 0, " high").otherwise(" low")))
    return rules.finding(
        g, RULE, "anomaly", F.lit("medium"), F.lit(0.5), F.col("host"), F.col("flow_id"),
        F.concat(F.col("host"), F.lit(" → "), F.col("peer"), F.lit(": "), F.get(said, F.lit(0)), F.lit(" for this capture")),
        F.concat(F.lit("Set apart from the other flows of this capture by "), F.array_join(F.slice(said, 1, 3), ", "), F.lit(". A statistical signal: no threshold was compared and nothing is proven by it.")),
        F.struct(F.lit("isolation forest over this capture alone").alias("model"), F.round("score", 4).alias("isolation_score"), F.col("reasons").alias("unusual_features"), F.lit(LIMIT).alias("limitation")),
    ).withColumn("method", F.lit("model"))
