"""Internet addresses as sortable keys, and what a fetch may reach: a look-up in sorted, disjoint ranges.

A key is 32 hexadecimal digits; an IPv4 address, alone or mapped into IPv6, has the key of its mapped form. The most
specific network that holds an address decides; networks are laid out once as disjoint ranges over the whole space.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks by what a fetch does with them. ``open`` ones are exceptions inside a blocked network.
METADATA = ("169.254.169.254/32", "fd00:ec2::254/128", "100.100.100.200/32")
BLOCKED = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16",
    "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
OPEN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28", "::ffff:0:0/96")
_MAPPED = 0xFFFF << 32


def disjoint(networks: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(first key, kind) of ranges that follow each other over the whole space; the longest prefix decides, none is ``open``."""
    spans = []
    for text, kind in networks:
        net = ipaddress.ip_network(text)
        base, bits = (_MAPPED, 96) if net.version == 4 else (0, 0)
        spans.append((net.prefixlen + bits, base + int(net.network_address), base + int(net.broadcast_address), kind))
    edges = sorted({0, *[s[1] for s in spans], *[s[2] + 1 for s in spans if s[2] + 1 < 1 << 128]})
    out: list[tuple[str, str]] = []
    for at in edges:
        kind = max(((n, k) for n, lo, hi, k in spans if lo <= at <= hi), default=(0, "open"))[1]
        if not out or out[-1][1] != kind:
            out.append((f"{at:032x}", kind))
    return out


RANGES = disjoint([(n, "metadata") for n in METADATA] + [(n, "blocked") for n in BLOCKED] + [(n, "open") for n in OPEN])


def _quads(text: Column) -> Column:
    """Eight hexadecimal digits of a dotted address; null where it is none (four numbers to 255, no leading zeros)."""
    part = r"(?:0|[1-9]\d{0,2})"
    numbers = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    ok = text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    return F.when(ok, F.when(F.forall(numbers, lambda x: x <= 255), F.array_join(F.transform(numbers, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: columns are trees, and one used often would be computed each time."""
    return F.transform(F.array(value), use)[0]


def _groups(plain: Column) -> Column:
    """The key of an IPv6 address without an IPv4 tail, in lower case."""

    def whole(sides: Column) -> Column:
        left, right = (F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda x: x != "") for i in (0, 1))
        return F.struct(left.alias("left"), right.alias("right"), (F.size(sides) == 2).alias("short"), F.size(sides).alias("n"))

    def key(g: Column) -> Column:
        gap = F.lit(8) - F.size(g["left"]) - F.size(g["right"])
        all_ = F.concat(g["left"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), g["right"])
        ok = F.when(g["short"], gap >= 1).otherwise((g["n"] == 1) & (gap == 0)) & F.forall(all_, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return F.when(ok, F.array_join(F.transform(all_, lambda x: F.lpad(x, 4, "0")), ""))

    shaped = plain.contains(":") & ~plain.rlike("^:[^:]|[^:]:$|:::")
    return F.when(shaped, _bound(whole(F.split(plain, "::")), key))


def address_key(text: Column) -> Column:
    """The key of an address in text form, without its zone; null for anything else."""

    def v6(t: Column) -> Column:
        tail = F.regexp_extract(t, r":([0-9.]+\.[0-9.]+)$", 1)

        def joined(x: Column) -> Column:  # an IPv4 tail as two groups; a bad one makes a group that is none
            hexed = F.coalesce(F.concat(F.substring(x["quads"], 1, 4), F.lit(":"), F.substring(x["quads"], 5, 4)), F.lit("x"))
            return F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(x["tail"])), hexed)

        return _bound(F.when(tail == "", t).otherwise(_bound(F.struct(tail.alias("tail"), _quads(tail).alias("quads")), joined)), _groups)

    t = F.lower(F.split_part(F.trim(text), F.lit("%"), F.lit(1)))
    return _bound(t, lambda t: F.when(t.contains(":"), v6(t)).otherwise(F.concat(F.lit("0" * 20 + "ffff"), _quads(t))))


def address_kind(key: Column) -> Column:
    """``metadata``, ``blocked`` or ``open``; null for a null key. The key is computed once and meets log(ranges) bounds."""

    def among(k: Column, lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(RANGES[lo][1])
        mid = (lo + hi) // 2
        return F.when(k < RANGES[mid][0], among(k, lo, mid)).otherwise(among(k, mid, hi))

    return _bound(key, lambda k: F.when(k.isNotNull(), among(k, 0, len(RANGES))))
