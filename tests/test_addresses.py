"""Addresses against the standard library's parser and predicates; redirect chains by the cases of the rule."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import addresses
from quillspark.operators.fetching import _grant, checked_hops

METADATA = [ipaddress.ip_network(n) for n in addresses.METADATA]


def kind(text):
    try:
        ip = ipaddress.ip_address(text.split("%")[0].strip())
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if any(ip in n for n in METADATA):
        return "metadata"
    return "blocked" if ip.is_loopback or ip.is_link_local or ip.is_private or ip.is_multicast or ip.is_reserved or ip.is_unspecified else "open"


def test_kinds_agree_with_the_standard_library(spark):
    rng = random.Random(8)
    texts = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(600)]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(16) << rng.choice([0, 16, 64, 96, 112]))) for _ in range(300)]
    texts += [str(ipaddress.IPv6Address(0x2001 << 112 | rng.getrandbits(rng.choice([100, 104, 112])))) for _ in range(100)]
    for n in (*addresses.BLOCKED, *addresses.OPEN, *addresses.METADATA):  # both edges, and one beyond
        net = ipaddress.ip_network(n)
        for at in (int(net.network_address) - 1, int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1):
            if 0 <= at < 1 << net.max_prefixlen:
                texts.append(str(type(net.network_address)(at)))
    texts += ["::ffff:10.0.0.1", "::FFFF:8.8.8.8", "::", "::1", "1::", "fe80::1%eth0", " 8.8.8.8 ", "2606:4700:0:0:0:0:0:1", "0:0:0:0:0:ffff:127.0.0.1"]
    texts += ["", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1", "1:", ":::", "12345::", "g::", "::1.2.3.400", "1:2:3:4:5:6:7::8", "host.example"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got = {r.t: r.k for r in df.select("t", addresses.address_kind(addresses.address_key(F.col("t"))).alias("k")).collect()}
    want = {t: kind(t) for t in texts}
    assert {t: (got[t], want[t]) for t in want if got[t] != want[t]} == {}


def test_ranges_are_sorted_and_disjoint():
    keys = [k for k, _ in addresses.RANGES]
    assert keys == sorted(set(keys)) and keys[0] == "0" * 32
    assert all(a[1] != b[1] for a, b in zip(addresses.RANGES, addresses.RANGES[1:], strict=False))


@pytest.mark.parametrize("entry, want", [("h", ("h", None)), (" H:80 ", ("h", 80)), ("[::1]", ("::1", None)), ("[::1]:8", ("::1", 8)), ("fe80::1", ("fe80::1", None)), ("", None), ("h:x", None), ("[::1", None), ("[::1]x", None), (":80", None)])
def test_entries(entry, want):
    assert _grant(entry) == want


PUBLIC, PRIVATE = ["93.184.216.34"], ["10.1.2.3"]
CASES = {
    "public": ([("https://a.example/x", PUBLIC)], (1, "ok", True)),
    "private": ([("https://b.example/x", PRIVATE)], (0, "blocked", True)),
    "allowed": ([("https://wiki.intern/x", PRIVATE)], (1, "ok", True)),
    "allowed, other port": ([("https://port.intern/x", PRIVATE)], (0, "blocked", True)),
    "allowed port": ([("https://PORT.intern:8443/x", PRIVATE)], (1, "ok", True)),
    "mixed records": ([("https://a.example/", PUBLIC + ["127.0.0.1"])], (0, "blocked", True)),
    "no records": ([("https://a.example/", [])], (0, "no address", True)),
    "null records": ([("https://a.example/", None)], (0, "no address", True)),
    "metadata though allowed": ([("http://wiki.intern/", ["::ffff:169.254.169.254"])], (0, "metadata", True)),
    "redirect to private": ([("https://wiki.intern/", PRIVATE), ("https://b.example/", PRIVATE)], (1, "blocked", True)),
    "redirect to metadata": ([("https://wiki.intern/", PRIVATE), ("http://m.example/", ["100.100.100.200"])], (1, "metadata", True)),
    "other host drops": ([("https://a.example/", PUBLIC), ("https://c.example/", PUBLIC), ("https://a.example/", PUBLIC)], (3, "ok", False)),
    "same origin keeps": ([("https://a.example/", PUBLIC), ("https://A.example:443/y", PUBLIC)], (2, "ok", True)),
    "downgrade drops": ([("https://a.example/", PUBLIC), ("http://a.example/", PUBLIC)], (2, "ok", False)),
    "upgrade keeps": ([("http://a.example/", PUBLIC), ("https://a.example/", PUBLIC)], (2, "ok", True)),
    "upgrade from a port drops": ([("http://a.example:8080/", PUBLIC), ("https://a.example/", PUBLIC)], (2, "ok", False)),
    "scheme": ([("file:///etc/passwd", PUBLIC)], (0, "scheme", True)),
    "too many": ([("https://a.example/", PUBLIC)] * 9, (6, "redirects", True)),
    "as many as allowed": ([("https://a.example/", PUBLIC)] * 6, (6, "ok", True)),
}


def test_chains(spark):
    rows = [(name, i, url, ips) for name, (hops, _) in CASES.items() for i, (url, ips) in enumerate(hops)]
    df = spark.createDataFrame(rows, "request string, hop int, url string, addresses array<string>").repartition(4)
    got = {r.request: (r.made, r.verdict, r.credentials) for r in checked_hops(df, ["Wiki.intern", "port.intern:8443", "[bad"]).collect()}
    assert got == {name: want for name, (_, want) in CASES.items()}


def test_an_address_is_computed_once_however_many_ranges_there_are(spark):
    """The key's expression is not repeated for each range."""
    df = spark.createDataFrame([("10.0.0.1",)], "a string")
    key = addresses.address_key(F.col("a"))
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
    alone, looked_up = (plan(c).count("rlike") for c in (key, addresses.address_kind(key)))
    assert alone == looked_up > 0
