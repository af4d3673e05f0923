import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wiretide.functions import expressions as E


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(column.alias("x")).first()["x"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=20))
def test_entropy(spark, blobs):
    df = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary")
    for b, r in zip(blobs, df.select(E.shannon_entropy("b").alias("h")).collect(), strict=True):
        want = -sum(c / len(b) * math.log2(c / len(b)) for c in Counter(b).values()) if b else 0.0
        assert abs(r["h"] - want) < 1e-4


def test_networks(spark):
    cases = [("10.1.2.3", True), ("11.0.0.1", False), ("fd00::1", True), ("fe00::1", False), ("", False), (None, False), ("10.0.0.300", False), ("::ffff", False)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "ip string")
    assert [r[0] for r in df.select(E.in_nets("ip", E.DEFAULT_HOME)).collect()] == [w for _, w in cases]
    link = [("224.0.0.5", True), ("255.255.255.255", True), ("169.254.3.3", True), ("ff02::1", True), ("fe80::1", True), ("fec0::1", False), ("8.8.8.8", False)]
    df = spark.createDataFrame([(a,) for a, _ in link], "ip string")
    assert [r[0] for r in df.select(E.is_link_scoped("ip")).collect()] == [w for _, w in link]
    assert E.parse_nets("10.45.57.0/24, nonsense") == ["10.45.57.0/24"]
    assert E.parse_nets(None) == list(E.DEFAULT_HOME)


def test_statistics(spark):
    a = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4, 100)])
    assert value(spark, E.median_of(a)) == 3
    assert value(spark, E.pct_index(a, 0.25)) == 2  # round(0.25 * 4) = 1
    assert value(spark, E.pct_index(a, 0.625)) == 3  # round(2.5) is 2
    assert value(spark, E.bowley(a)) == 0  # narrow
    assert value(spark, E.madm(a)) == 1 - 1 / 3
    assert value(spark, E.ceil3(F.lit(0.1231))) == 0.124
    assert value(spark, E.rnd(F.lit(2.5))) == 2


def test_names(spark):
    rules = {"uk": "rule", "co.uk": "rule", "ck": "wildcard", "www.ck": "exception", "com": "rule"}
    cases = {"a.b.example.co.uk": "example.co.uk", "example.com": "example.com", "x.y.z.ck": "y.z.ck", "a.www.ck": "www.ck", "co.uk": "co.uk", "4.3.2.1.in-addr.arpa": "3.2.1.in-addr.arpa", "host": "host"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert [r[0] for r in df.select(E.registered_domain("n", rules)).collect()] == list(cases.values())
    assert value(spark, E.label_suffixes("n"), n="A.b.C.") == ["a.b.c", "b.c"]
    f = value(spark, E.dns_features("n"), n="abcd.xy.example.com")
    assert (f["subdomain_length"], f["label_count"]) == (4, 4)


def test_upper_bound(spark):
    df = spark.createDataFrame([(2, 22), (0, 22), (10, 22), (22, 22), (0, 0), (4, 8)], "k int, n int")
    got = [round(r[0], 4) for r in df.select(E.binomial_upper(F.col("k"), F.col("n"))).collect()]
    assert got == [0.2595, 0.1273, 0.6475, 1.0, 1.0, 0.8071]


def test_flags(spark):
    assert value(spark, E.tcp_flags("f"), f=18) == "AS"
    assert value(spark, E.human_bytes("n"), n=1_500_000) == "1.5 MB"
