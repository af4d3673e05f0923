"""Scalar building blocks as Column expressions: addresses, names, statistics, entropy, text."""

from __future__ import annotations

import ipaddress
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that count as inside where a session declares none, and those that never leave a link.
DEFAULT_HOME = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fd00::/8")
LINK_SCOPED = ("224.0.0.0/4", "255.255.255.255/32", "169.254.0.0/16", "ff00::/8", "fe80::/10")
# Rank and risk weight of severities.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_WEIGHT = {"low": 10, "medium": 35, "high": 70, "critical": 95}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def ip_hex(ip: Column | str) -> Column:
    """An address as 8 (IPv4) or 32 (IPv6) hex digits, so that ranges compare as strings; NULL if it isn't one."""
    ip = col(ip)
    parts = F.split(ip, r"\.")
    octet = lambda i: F.lpad(F.lower(F.hex(parts[i].cast("int"))), 2, "0")
    four = F.when(F.exists(parts, lambda p: p.cast("int") > 255), None).otherwise(F.concat(*[octet(i) for i in range(4)]))
    pad = lambda a: F.array_join(F.transform(F.filter(F.split(a, ":"), lambda p: p != ""), lambda p: F.lpad(F.lower(p), 4, "0")), "")
    head, tail = pad(F.substring_index(ip, "::", 1)), pad(F.when(F.contains(ip, F.lit("::")), F.substring_index(ip, "::", -1)).otherwise(F.lit("")))
    six = F.concat(head, F.repeat(F.lit("0"), F.lit(32) - F.length(head) - F.length(tail)), tail)
    ok = F.contains(ip, F.lit("::")) | (F.length(head) == 32)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), four).when(ip.rlike(r"^[0-9A-Fa-f:]{2,39}$") & F.contains(ip, F.lit(":")) & ok & (F.length(six) == 32), six)


def net_range(net: str) -> tuple[str, str]:
    n = ipaddress.ip_network(net.strip(), strict=False)
    width = n.max_prefixlen // 4
    return f"{int(n.network_address):0{width}x}", f"{int(n.broadcast_address):0{width}x}"


def parse_nets(declared: str | None, default: tuple[str, ...] = DEFAULT_HOME) -> list[str]:
    """Declared networks (comma-joined) that parse, else the default ones."""
    good = []
    for part in (declared or "").split(","):
        try:
            good.append(str(ipaddress.ip_network(part.strip(), strict=False)))
        except ValueError:
            continue
    return good or list(default)


def describe_nets(nets) -> str:
    """The networks that a finding was judged by, as its evidence names them."""
    return ", ".join(str(ipaddress.ip_network(n.strip(), strict=False)) for n in nets)


def fingerprint(c: Column | str) -> Column:
    """A fingerprint's hex digits alone, in lower case; empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^0-9a-f]", "")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def _number(n: int) -> str:
    """A number up to 255 as an address may write it, with leading zeros to three digits."""
    return f"{'0?' * (3 - len(str(n)))}{n}"


def _net_pattern(net: str) -> str | None:
    """A pattern of the addresses of a network, or None where one doesn't follow from its prefix.

    Whole octets are written out, a divided one as its numbers.  For IPv6 the first group must decide, and have no zeros
    that may be left out."""
    n = ipaddress.ip_network(net.strip(), strict=False)
    bits, start = n.prefixlen, n.network_address
    if n.version == 4:
        octets = list(start.packed)
        whole, part = divmod(bits, 8)
        out = [_number(o) for o in octets[:whole]]
        if part:
            out.append(f"(?:{'|'.join(_number(o) for o in range(octets[whole], octets[whole] + (1 << 8 - part)))})")
        return r"\.".join(out + [_OCTET] * (4 - len(out)))
    first = int(start) >> 112
    if bits > 16 or first < 0x1000:
        return None
    digits, part = divmod(bits, 4)
    text = f"{first:04x}"
    out = [f"[{d}{d.upper()}]" if d.isalpha() else d for d in text[:digits]]
    if part:
        low = int(text[digits], 16)
        some = [f"{d:x}" for d in range(low, low + (1 << 4 - part))]
        out.append(f"[{''.join(some)}{''.join(d.upper() for d in some if d.isalpha())}]")
    tail = "[0-9A-Fa-f]" * (4 - len(out))
    return f"(?=[0-9A-Fa-f:]{{2,39}}$)(?=.*::|(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$){''.join(out)}{tail}:.*"


def in_nets(ip: Column | str, nets) -> Column:
    """Whether an address is in any of the networks; never NULL.

    Lists are configuration.  Networks that a pattern describes become one regular expression, which stays inside code
    generation; others compare as ranges."""
    known = {n: _net_pattern(n) for n in nets}
    patterns, ranges = [p for p in known.values() if p], [n for n, p in known.items() if not p]
    out = F.coalesce(col(ip).rlike(f"^(?:{'|'.join(patterns)})$"), F.lit(False)) if patterns else F.lit(False)
    if ranges:
        held = let(ip_hex(ip), lambda x: _any([(F.length(x) == len(lo)) & x.between(F.lit(lo), F.lit(hi)) for lo, hi in map(net_range, ranges)]))
        out = out | F.coalesce(held, F.lit(False))
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_link_scoped(ip: Column | str) -> Column:
    return in_nets(ip, LINK_SCOPED)


def group_key(ip: Column | str) -> Column:
    """The /24 of an IPv4 address, the /64 of an IPv6 one."""
    h = ip_hex(ip)
    return F.when(F.length(h) == 8, F.concat(F.substring_index(col(ip), ".", 3), F.lit(".0/24"))).when(F.length(h) == 32, F.concat(F.substring(h, 1, 16), F.lit("/64")))


def initiator() -> Column:
    return F.coalesce("initiator_ip", "src_ip")


def peer() -> Column:
    return F.when(initiator() == F.col("src_ip"), F.col("dst_ip")).otherwise(F.col("src_ip"))


def service_port() -> Column:
    """The responder's port, whichever end was recorded as the source."""
    return F.when(initiator() == F.col("src_ip"), F.col("dst_port")).otherwise(F.col("src_port"))


def ends() -> Column:
    """Columns host and peer: a generator, so that tests of them stay above it and read its values.

    A filter over a projection would be carried down with a copy of how an end is found for each use of it."""
    return F.inline(F.array(F.struct(initiator().alias("host"), peer().alias("peer"))))


def egress(nets, host: Column | str | None = None, far: Column | str | None = None) -> Column:
    host, far = initiator() if host is None else host, peer() if far is None else far
    return in_nets(host, nets) & ~in_nets(far, nets) & ~is_link_scoped(far)


def severity_rank(c: Column | str = "severity") -> Column:
    return _case(c, SEVERITY_RANK, 0)


def severity_weight(c: Column | str = "severity") -> Column:
    return _case(c, SEVERITY_WEIGHT, 0)


def _case(c, table: dict, default) -> Column:
    """A column's value in a table, as one lookup."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col(c)), F.lit(default))


def rnd(c: Column | str, digits: int = 0) -> Column:
    """Rounded half to even on the binary value scaled up, which is how the figures this engine matches are rounded."""
    return F.rint(col(c) * 10.0**digits) / 10.0**digits


def ceil3(c: Column) -> Column:
    return F.ceil(c * 1000) / 1000


def pct_index(sorted_values: Column, p: float) -> Column:
    """The element at round-half-even(p * (n - 1)), without interpolation."""
    return F.element_at(sorted_values, F.bround(F.lit(p) * (F.size(sorted_values) - 1), 0).cast("int") + 1)


def median_of(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    return (F.element_at(sorted_values, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_values, F.floor(n / 2).cast("int") + 1)) / 2


def mad_of(values: Column, median: Column) -> Column:
    return let(F.array_sort(F.transform(values, lambda v: F.abs(v - median))), median_of)


def bowley(s: Column, floor: float = 10) -> Column:
    """Quartile skew of a sorted array; 0 where too few, too narrow or one-sided values say nothing."""
    q = F.struct(pct_index(s, 0.25).alias("a"), pct_index(s, 0.5).alias("b"), pct_index(s, 0.75).alias("c"))
    body = lambda x: F.when((F.size(s) < 3) | (x.c - x.a < floor) | (x.b == x.a) | (x.b == x.c), F.lit(0.0)).otherwise((x.a + x.c - 2 * x.b) / (x.c - x.a))
    return F.when(F.size(s) < 3, F.lit(0.0)).otherwise(let(q, body))


def madm(s: Column) -> Column:
    """1 - MAD / median of a sorted array, at least 0; 0 without a positive median."""
    return let(median_of(s), lambda m: F.when(m > 0, F.greatest(F.lit(0.0), 1 - mad_of(s, m) / m)).otherwise(F.lit(0.0)))


def shannon_entropy(data: Column | str) -> Column:
    """Bits for each byte of a binary column, to 4 digits; 0 if empty.  One character stands for each byte; those that
    occur are counted by what is left without them."""
    n = F.octet_length(col(data))

    def of(s):
        kinds = F.sort_array(F.array_distinct(F.split(s, "")))
        count = lambda b: (F.octet_length(s) - F.octet_length(F.replace(s, b, F.lit("")))) / F.octet_length(b)
        counts = F.transform(kinds, count)
        return F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / n * F.log2(c / n))

    return F.when(n >= 1, rnd(let(F.decode(col(data), "iso-8859-1"), of), 4)).otherwise(F.lit(0.0))


def dns_features(name: Column | str) -> Column:
    """Struct of a query name's longest subdomain label, label count and the entropy of its subdomain."""
    labels = F.split(F.regexp_replace(col(name), r"^\.+|\.+$", ""), r"\.")
    sub = F.when(F.size(labels) > 2, F.slice(labels, F.lit(1), F.size(labels) - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.coalesce(F.array_max(F.transform(sub, F.length)), F.lit(0))
    return F.struct(longest.alias("subdomain_length"), F.size(labels).alias("label_count"), shannon_entropy(F.encode(F.array_join(sub, ""), "utf-8")).alias("query_entropy"))


def label_suffixes(name: Column | str) -> Column:
    """All suffixes of a name with at least two labels, longest first."""
    labels = F.split(F.regexp_replace(F.lower(col(name)), r"\.+$", ""), r"\.")
    return F.when(F.size(labels) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def registered_domain(name: Column | str, rules: dict[str, str] | None = None) -> Column:
    """The name under its public suffix.  rules: suffix -> 'rule', 'wildcard' or 'exception'; without a rule the last label
    is the suffix.  Reverse zones: the /24 of in-addr.arpa, the first 16 nibbles of ip6.arpa."""
    n = F.regexp_replace(F.lower(col(name)), r"^\.+|\.+$", "")
    labels = F.split(n, r"\.")
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - k + 1), F.size(labels)), ".")
    plain = F.when(F.size(labels) < 2, n).otherwise(tail(F.lit(2)))
    out = plain
    if rules:
        # Longest suffix that a rule names, counted in labels; an exception counts one label less.
        m = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
        at = lambda k: F.element_at(m, F.array_join(F.slice(labels, F.size(labels) - k + 1, F.size(labels)), "."))
        width = lambda k: F.when(at(k) == "exception", k - 1).when((at(k) == "wildcard") & (F.size(labels) > k), k + 1).when(at(k) == "rule", k).otherwise(F.lit(0))
        has_exception = F.exists(F.sequence(F.lit(1), F.size(labels)), lambda k: F.coalesce(at(k) == "exception", F.lit(False)))
        widths = F.transform(F.sequence(F.lit(1), F.size(labels)), width)
        exception = F.array_max(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.when(at(k) == "exception", k - 1).otherwise(F.lit(0))))
        suffix = F.when(has_exception, exception).otherwise(F.greatest(F.lit(1), F.array_max(widths)))
        out = let(suffix, lambda w: F.when(F.size(labels) <= w, n).otherwise(tail(w + 1)))
    v4 = F.regexp_extract(n, r"(?:^|\.)((?:\d{1,3}\.){3}in-addr\.arpa)$", 1)
    v6 = F.regexp_extract(n, r"(?:^|\.)((?:[0-9a-f]\.){16}ip6\.arpa)$", 1)
    return F.when(v4 != "", v4).when(v6 != "", v6).otherwise(out)


def human_bytes(n: Column | str) -> Column:
    n = col(n)
    return F.when(n >= 1e9, F.format_string("%.1f GB", n / 1e9)).when(n >= 1e6, F.format_string("%.1f MB", n / 1e6)).when(n >= 1e3, F.format_string("%.1f KB", n / 1e3)).otherwise(F.format_string("%d bytes", n.cast("long")))


def tcp_flags(flags: Column | str) -> Column:
    """Letters of the set flags, in alphabetical order."""
    f = col(flags)
    # Flag bits.
    bits = {"A": 16, "F": 1, "P": 8, "R": 4, "S": 2, "U": 32}
    return F.concat(*[F.when(f.bitwiseAND(b) > 0, F.lit(k)).otherwise(F.lit("")) for k, b in bits.items()])


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series from x + 8 on: absolute error below 1e-12 times its size."""
    y = x + 8
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    below = x
    for i in range(1, 8):
        below = below * (x + i)
    return (y - 0.5) * F.log(y) - y + math.log(2 * math.pi) / 2 + series - F.log(below)


def binomial_upper(k: Column, n: Column, alpha: float = 0.05, rounds: int = 60) -> Column:
    """One-sided exact (Clopper-Pearson) upper bound of a rate, by bisection inside the expression.

    The bound of a risk below a half lies above k / n.  There the probabilities of k, k - 1, ... hits only fall, that of j
    fewer by more than exp(-j (j - 1) / 2k): beyond ten roots of k they are below the last digit of the sum."""
    if not 0 < alpha < 0.5:
        raise ValueError(f"the risk of a one-sided bound is below a half, not {alpha}")
    k, n = k.cast("double"), n.cast("double")
    log_c = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    most = F.greatest(k, F.lit(1.0)).cast("int")
    last = F.greatest(F.lit(1), most - 10 * F.ceil(F.sqrt(most)).cast("int") - 10)

    def fewer(p):
        odds = (1 - p) / p
        down = lambda a, i: let(a.term * odds * i / (n - i + 1), lambda t: F.struct(t.alias("term"), (a.all + t).alias("all")))
        terms = F.aggregate(F.sequence(most, last, F.lit(-1)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("all")), down, lambda a: a.all)
        return F.exp(log_c + k * F.log(p) + (n - k) * F.log(1 - p)) * terms

    step = lambda s, _: let((s.lo + s.hi) / 2, lambda mid: F.when(fewer(mid) > alpha, F.struct(mid.alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), mid.alias("hi"))))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct((k / n).alias("lo"), F.lit(1.0).alias("hi")), step, lambda s: s.hi)
    return F.when(n <= 0, F.lit(1.0)).when(k >= n, F.lit(1.0)).when(k <= 0, 1 - F.pow(F.lit(alpha), 1 / n)).otherwise(found)
