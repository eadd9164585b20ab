"""Network addresses as 128 bits: parsing, networks that aren't public, longest-prefix match.

An address is a string of 32 hexadecimal digits, which sorts as its number does; an
IPv4 address is the IPv6 one that maps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import bound

# Registries of special-purpose networks.  Private, loopback, link-local, reserved and multicast ones; parts of them that are public.
BLOCKED_V4 = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()
PUBLIC_V4 = "192.0.0.9/32 192.0.0.10/32".split()
BLOCKED_V6 = "::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 2001::/23 2001:db8::/32 2002::/16 4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fc00::/7 fe00::/9 fe80::/10 ff00::/8".split()
PUBLIC_V6 = "::ffff:0:0/96 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_MAPPED = "0" * 20 + "ffff"


def _octets(v4: Column) -> Column:
    return F.array_join(F.transform(F.split(v4, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0")), "")


def address(text: Column) -> Column:
    """The address that text is, in any of its spellings (brackets around it and a zone are left out); null if it is none."""
    t = F.lower(F.trim(F.coalesce(text, F.lit("")), F.lit("[] \t")))
    return bound(F.regexp_replace(t, r"%[^%/]+$", ""), lambda bare: F.when(bare.rlike(f"^{V4}$"), F.concat(F.lit(_MAPPED), _octets(F.when(bare.rlike(f"^{V4}$"), bare).otherwise("0.0.0.0")))).otherwise(bound(_hexadecimal(bare), _v6)))


def _hexadecimal(bare: Column) -> Column:
    """An IPv6 address whose end, if that is an IPv4 address, is written in two hexadecimal groups."""

    def ended(tail: Column) -> Column:
        groups = lambda digits: F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))
        return F.when(tail == "", bare).otherwise(bound(_octets(F.when(tail != "", tail).otherwise("0.0.0.0")), groups))

    return bound(F.regexp_extract(bare, f"(?<=:)({V4})$", 1), ended)


def _v6(whole: Column) -> Column:
    """The address that hexadecimal groups are; null if they are none."""
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    padded = lambda side: F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), "")
    short = F.contains(whole, F.lit("::"))
    left, right = groups(F.substring_index(whole, "::", 1)), groups(F.when(short, F.substring_index(whole, "::", -1)).otherwise(""))
    sound = whole.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")

    def joined(sides: Column) -> Column:
        count = F.size(sides["left"]) + F.size(sides["right"])
        filled = F.concat(padded(sides["left"]), F.when(short, F.repeat(F.lit("0"), 4 * (8 - count))).otherwise(""), padded(sides["right"]))
        return F.when(F.when(short, count <= 7).otherwise(count == 8), filled)

    return F.when(sound, bound(F.struct(left.alias("left"), right.alias("right")), joined))


def network_range(network: str) -> tuple[int, int]:
    """First and last address of a literal network."""
    text, _, bits = network.partition("/")
    if "." in text and ":" not in text:
        number, bits = 0xFFFF << 32 | sum(int(p) << (24 - 8 * k) for k, p in enumerate(text.split("."))), int(bits or 32) + 96
    else:
        left, gap, right = text.partition("::")
        a, b = ([int(g, 16) for g in side.split(":") if g] for side in (left, right))
        groups = a + [0] * (8 - len(a) - len(b)) * bool(gap) + b
        number, bits = sum(g << (112 - 16 * k) for k, g in enumerate(groups)), int(bits or 128)
    first = number >> (128 - bits) << (128 - bits)
    return first, first + (1 << (128 - bits)) - 1


def flattened(networks: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """Ascending first addresses of ranges and what the longest network around each says; outside of all: False."""
    ranges = sorted((*network_range(n), said) for n, said in networks)
    edges = sorted({0} | {a for a, _, _ in ranges} | {b + 1 for _, b, _ in ranges if b + 1 < 1 << 128})
    out: list[tuple[str, bool]] = []
    for e in edges:
        around = [(b - a, said) for a, b, said in ranges if a <= e <= b]
        said = min(around)[1] if around else False
        if not out or out[-1][1] != said:
            out.append((f"{e:032x}", said))
    return out


_RANGES = flattened([(n, True) for n in (*BLOCKED_V4, *BLOCKED_V6)] + [(n, False) for n in (*PUBLIC_V4, *PUBLIC_V6)])


def is_special(address_: Column) -> Column:
    """Whether an address (``address``) isn't public: the last range that begins before it says so; null for none."""
    starts = F.array(*[F.lit(start) for start, _ in _RANGES])
    place = lambda a: F.size(F.filter(starts, lambda s: s <= a))
    said = F.array(*[F.lit(said) for _, said in _RANGES])
    return bound(address_, lambda a: F.when(a.isNotNull(), F.element_at(said, F.greatest(place(a), F.lit(1)))))


def bits(address_: Column) -> Column:
    """The 128 bits as text."""
    half = lambda a, at: F.lpad(F.conv(F.substring(a, at, 16), 16, 2), 64, "0")
    return bound(address_, lambda a: F.concat(half(a, 1), half(a, 17)))


def longest_match(addresses: DataFrame, networks: DataFrame, column: str = "address") -> DataFrame:
    """addresses with network: the longest of the networks (column network, "a.b.c.d/n" or "x::y/n") around it, null if none is.

    Each address asks for its prefix of every length that occurs among the networks
    (129 at most), by an equality join; sets of networks of any size are joined, not
    sent around.
    """
    text, length = F.substring_index("network", "/", 1), F.regexp_extract("network", "/([0-9]+)$", 1).cast("int")
    number = address(text)
    v4 = text.rlike(f"^{V4}$")
    size = F.when(v4, F.coalesce(length, F.lit(32)) + 96).otherwise(F.coalesce(length, F.lit(128)))
    known = networks.select("network", size.alias("size"), F.substring(bits(number), F.lit(1), size).alias("prefix")).filter(number.isNotNull()).dropDuplicates(["prefix"])
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    asked = addresses.select(column).distinct().withColumn("_bits", bits(address(F.col(column)))).filter("_bits is not null")
    asked = asked.select(column, F.explode(F.transform(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"), lambda n: F.substring(F.col("_bits"), F.lit(1), n))).alias("prefix"))
    place = F.row_number().over(Window.partitionBy(column).orderBy(F.desc("size")))
    found = asked.join(known, "prefix").withColumn("_place", place).filter("_place = 1").select(column, "network")
    return addresses.join(found, column, "left")
