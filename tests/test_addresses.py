"""Addresses against the standard library's module: spellings, special networks, longest prefixes."""

import ipaddress
import random

from pyspark.sql import functions as F

from webloom.functions import addresses
from webloom.operators import crawler


def special(text):
    """What a resolver's guard refuses."""
    ip = ipaddress.ip_address(text)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified


def some_addresses(n, seed):
    draw = random.Random(seed)
    known = [ipaddress.ip_network(x) for x in (*addresses.BLOCKED_V4, *addresses.BLOCKED_V6, *addresses.PUBLIC_V4, *addresses.PUBLIC_V6)]
    out = []
    for _ in range(n):
        net = draw.choice(known)
        first, last = int(net[0]), int(net[-1])
        number = draw.choice([first, last, first - 1, last + 1, draw.randint(first, last), draw.getrandbits(32 if net.version == 4 else 128)])
        number = min(max(number, 0), (1 << (32 if net.version == 4 else 128)) - 1)
        ip = (ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address)(number)
        if net.version == 4:
            out.append(draw.choice([str(ip), f"::ffff:{ip}", f"[::FFFF:{ip}]"]))
        else:
            out.append(draw.choice([str(ip), ip.exploded, ip.compressed.upper(), f"{ip}%eth0"]))
    return out


def bare(text):
    return text.strip("[]").split("%")[0]


def test_ten_thousand_addresses_as_the_module_has_them(spark):
    texts = some_addresses(10_000, 1)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.address(F.col("t")).alias("a"), addresses.is_special(addresses.address(F.col("t"))).alias("s"), crawler.host_is_blocked(F.col("t")).alias("b")).collect()
    for r in got:
        ip = ipaddress.ip_address(bare(r["t"]))
        assert int(r["a"], 16) == (int(ip) if ip.version == 6 else int(ip) + (0xFFFF << 32)), r["t"]
        assert r["s"] == special(bare(r["t"])) == r["b"], r["t"]


def test_what_is_no_address(spark):
    texts = ["", None, "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:2:3:4:5:6:7::8:9", "g::1", "12345::", "::1.2.3", "1.2.3.4::", "site.example", ":1", "1:"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(addresses.address(F.col("t"))).collect()
    assert [r[0] for r in got] == [None] * len(texts)
    assert spark.createDataFrame([("::",), ("1::",), ("::1.2.3.4",)], "t string").filter(addresses.address(F.col("t")).isNull()).count() == 0


def test_names_follow_what_they_resolve_to(spark):
    hosts = spark.createDataFrame([("A.example",), ("b.example",), ("c.example",), ("10.0.0.1",), (None,)], "host string")
    resolved = spark.createDataFrame([("a.example", "8.8.8.8"), ("a.example", "::ffff:10.1.1.1"), ("b.example", "2606:4700::1"), ("b.example", "nonsense")], "host string, address string")
    assert {r["host"]: r["blocked"] for r in crawler.hosts_blocked(hosts, resolved).collect()} == {"A.example": True, "b.example": False, "c.example": False, "10.0.0.1": True, None: True}
    assert {r["blocked"] for r in crawler.hosts_blocked(hosts.filter("host is not null"), resolved, True).collect()} == {False}


def test_longest_prefix(spark):
    draw = random.Random(2)
    nets = {str(ipaddress.ip_network((draw.getrandbits(32) & 0xF0FF0000 | draw.getrandbits(16), draw.randint(3, 32)), strict=False)) for _ in range(150)} | {"2001:db8::/32", "2001:db8:1::/48", "::/0"}
    ips = [str(ipaddress.ip_address(draw.getrandbits(32) & 0xF0FFFFFF)) for _ in range(300)] + ["2001:db8:1::5", "2001:db8:2::5", "9::", "x"]
    got = {r["address"]: r["network"] for r in addresses.longest_match(spark.createDataFrame([(i,) for i in ips], "address string"), spark.createDataFrame([(n,) for n in nets], "network string")).collect()}
    for text in ips[:-1]:
        ip = ipaddress.ip_address(text)
        fits = [n for n in map(ipaddress.ip_network, nets) if n.version == ip.version and ip in n]
        assert got[text] == (str(max(fits, key=lambda n: n.prefixlen)) if fits else "::/0"), text
    assert got["x"] is None
    assert addresses.longest_match(spark.createDataFrame([("1.2.3.4",)], "address string"), spark.createDataFrame([], "network string")).first()["network"] is None
