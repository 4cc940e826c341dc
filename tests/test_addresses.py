"""Addresses as numbers against the standard library's."""

import ipaddress
import random

from pyspark.sql import functions as F

from loomledger.functions import urls as U


def spelled(rng, number):
    """An address in one of its spellings."""
    address = ipaddress.ip_address(number)
    if address.version == 4:
        return str(address)
    digits = f"{int(address):032x}"
    full = ":".join(digits[i : i + 4] for i in range(0, 32, 4))
    forms = [str(address), full, full.upper(), f"[{address}]", f"{address}%eth0", ":".join(g.lstrip("0") or "0" for g in full.split(":")), full.rsplit(":", 2)[0] + ":" + str(ipaddress.IPv4Address(int(address) & 0xFFFFFFFF))]
    return rng.choice(forms)


def test_numbers_and_classes_by_range(spark):
    rng = random.Random(6)
    numbers = [0, 1, 2, 1 << 32, (1 << 128) - 1]
    for _, first, bits in U.IPV6_CLASSES:
        low, high = U._range(first, bits)
        numbers += [low, high, max(low - 1, 0), min(high + 1, (1 << 128) - 1)]
    numbers += [rng.getrandbits(128) for _ in range(100)] + [0xFFFF << 32 | rng.getrandbits(32) for _ in range(40)] + [rng.getrandbits(rng.randrange(1, 128)) for _ in range(100)]
    rows = [(spelled(rng, ipaddress.IPv6Address(n)), f"{n:032x}") for n in numbers]
    out = spark.createDataFrame(rows, "a string, want string").select("a", "want", U.ipv6_number(F.col("a")).alias("n"), U.ip_class(F.col("a")).alias("c")).collect()
    assert [(r.a, r.n) for r in out if r.n != r.want] == []
    for r in out:
        n = int(r.n, 16)
        inside = [name for name, first, bits in U.IPV6_CLASSES if U._range(first, bits)[0] <= n <= U._range(first, bits)[1]]
        if not inside and n >> 32 in (0, 0xFFFF):
            inside = [name for name, first, bits in U.IPV4_CLASSES if U._range(first, bits)[0] <= n & 0xFFFFFFFF <= U._range(first, bits)[1]]
        assert r.c == (inside[0] if inside else "public"), r


def test_spellings_that_hide_a_class(spark):
    cases = {"::ffff:7f00:1": "loopback", "0:0:0:0:0:ffff:10.0.0.1": "private", "2001:0db8::1": "documentation", "0:0:0:0:0:0:0:1": "loopback", "::": "unspecified", "0064:FF9B::8.8.8.8": "nat64", "FE80::1%lo": "link_local", "fc::1": "public", "::ffff:8.8.8.8": "public"}
    none = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1.2.3.4:1::", "::1.2.3", "::1.2.3.400", "1:2:3:4:5:6:7::8:9", ":1::2", "::1:", "1.2.3", "01.2.3.4.5", "fe80", "abc", None, "1::2 "]
    out = spark.createDataFrame([(a,) for a in [*cases, *none]], "a string").select("a", U.ip_class(F.col("a")).alias("c")).collect()
    assert {r.a: r.c for r in out} == cases | {a: None for a in none}
