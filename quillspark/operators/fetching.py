"""Which recorded fetches a safe client would make: every hop of a redirect chain is checked on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import address_key, address_kind


def _grant(entry: str) -> tuple[str, int | None] | None:
    """host and port of an entry ``host``, ``host:port``, ``[v6]``, ``[v6]:port`` or a bare v6 address; a malformed one grants nothing."""
    entry = entry.strip().lower()
    host, port = entry, ""
    if entry.startswith("["):
        host, closed, port = entry[1:].partition("]")
        if not closed or (port and not port.startswith(":")):
            return None
        port, asked = port[1:], bool(port)
    elif entry.count(":") == 1:
        host, _, port = entry.partition(":")
        asked = True
    else:
        asked = False
    if not host or (asked and not port.isdigit()):
        return None
    return host, int(port) if asked else None


def granted(host: Column, port: Column, entries: list[str]) -> Column:
    out = F.lit(False)
    for known in filter(None, map(_grant, entries)):
        out = out | (host == known[0]) & (F.lit(True) if known[1] is None else port == known[1])
    return out


def origin(url: Column) -> Column:
    """scheme, host and effective port of a URL."""
    parts = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d+))?", i)
    scheme = F.lower(parts(1))
    port = F.coalesce(F.nullif(parts(3), F.lit("")).cast("int"), F.when(scheme == "http", 80).when(scheme == "https", 443))
    return F.struct(scheme.alias("scheme"), F.lower(F.regexp_replace(parts(2), r"[\[\]]", "")).alias("host"), port.alias("port"))


def checked_hops(hops: DataFrame, allowed: list[str] = [], most_redirects: int = 5) -> DataFrame:  # noqa: B006
    """request, made, verdict, credentials: how far each fetch goes, why it ends, and whether its credentials are still sent.

    hops: request, hop (from 0), url, addresses (all that the host resolved to). A hop is refused for its ``scheme``,
    for ``no address`` or one that is none, for any ``metadata`` address whatever is allowed, and for any ``blocked``
    address unless its host (and port) is in ``allowed``. ``made`` counts the hops before the first refused one; more
    than ``most_redirects`` after the first end as ``redirects``. Credentials go with the first origin only, or with its
    upgrade from http to https on the default ports, and never come back once dropped. The hops of a request, most_redirects + 2 of
    them at most, meet in one aggregate; a hop that repeats counts once.
    """
    # one row an address, so that each is looked up once
    each = hops.filter(F.col("hop") <= most_redirects + 1).select("request", "hop", "url", F.explode_outer("addresses").alias("address"), F.size(F.coalesce("addresses", F.array().cast("array<string>"))).alias("n"))
    kind = F.coalesce(address_kind(address_key(F.col("address"))), F.lit("none"))
    has = {k: F.coalesce(F.bool_or((F.col("n") > 0) & (F.col("kind") == k)), F.lit(False)).alias(k) for k in ("none", "metadata", "blocked")}
    rows = each.withColumn("kind", kind).groupBy("request", "hop", "url").agg(*has.values(), F.max("n").alias("n")).withColumn("o", origin(F.col("url")))
    refused = (
        F.when(~F.col("o.scheme").isin("http", "https"), "scheme")
        .when((F.col("n") == 0) | F.col("none"), "no address")
        .when(F.col("metadata"), "metadata")
        .when(F.col("blocked") & ~granted(F.col("o.host"), F.col("o.port"), allowed), "blocked")
        .when(F.col("hop") > most_redirects, "redirects")
    )
    rows = rows.select("request", F.struct("hop", refused.alias("refused"), "o").alias("h"))
    chain = rows.groupBy("request").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    first = F.element_at("hs", 1)["o"]
    stop = F.coalesce(F.nullif(F.array_position(F.transform("hs", lambda h: h["refused"].isNotNull()), True), F.lit(0)) - 1, F.size("hs").cast("long"))
    made = F.slice("hs", F.lit(1), stop.cast("int"))

    def keeps(h: Column) -> Column:
        same = (h["o"]["scheme"] == first["scheme"]) & h["o"]["port"].eqNullSafe(first["port"])
        upgrade = (first["scheme"] == "http") & (h["o"]["scheme"] == "https") & (first["port"] == 80) & (h["o"]["port"] == 443)
        return (h["o"]["host"] == first["host"]) & (same | upgrade)

    verdict = F.coalesce(F.get("hs", stop.cast("int"))["refused"], F.lit("ok"))
    return chain.select("request", stop.alias("made"), verdict.alias("verdict"), F.forall(made, keeps).alias("credentials"))
