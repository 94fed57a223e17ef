"""Recorded redirect chains against the address rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.fetching import checked_hops
from .registry import Tables, query

ALLOWED = ["h3.example", "H4.example:8443", "[broken"]

#: IPv4 networks that are refused, as numbers, spelled out for the oracle.
PRIVATE = " OR ".join(
    f"n BETWEEN {lo} AND {hi}"
    for lo, hi in (
        (0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303), (3221225472, 3221225480), (3221225483, 3221225727), (3221225984, 3221226239),
        (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (3758096384, 4294967295),
    )
)


@query("src12_safe_hops", f"""WITH h AS (SELECT l_orderkey AS request, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS hop, l_partkey % 8 AS m,
    (l_partkey * 2654435761 + l_suppkey * 40503) % 4294967296 AS n, l_suppkey AS s, 'h' || (l_suppkey % 5) || '.example' AS host, CASE WHEN l_partkey % 23 = 0 THEN 'ftp' WHEN l_partkey % 3 = 0 THEN 'http' ELSE 'https' END AS scheme FROM lineitem),
  o AS (SELECT *, CASE WHEN s % 2 = 0 THEN 8443 WHEN scheme = 'http' THEN 80 WHEN scheme = 'https' THEN 443 END AS port FROM h),
  k AS (SELECT *, CASE WHEN scheme = 'ftp' THEN 'scheme' WHEN m = 5 OR m = 7 AND s % 2 = 1 THEN 'no address' WHEN m = 3 OR m < 3 AND n IN (2852039166, 1684301000) THEN 'metadata'
    WHEN (m IN (4, 6) OR m < 3 AND ({PRIVATE})) AND NOT (host = 'h3.example' OR host = 'h4.example' AND port = 8443) THEN 'blocked' WHEN hop > 3 THEN 'redirects' END AS refused,
    first_value(scheme) OVER c AS fs, first_value(host) OVER c AS fh, first_value(port) OVER c AS fp FROM o WINDOW c AS (PARTITION BY request ORDER BY hop)),
  e AS (SELECT *, coalesce(min(CASE WHEN refused IS NOT NULL THEN hop END) OVER (PARTITION BY request), count(*) OVER (PARTITION BY request)) AS made FROM k)
  SELECT request, any_value(made) AS made, coalesce(max(CASE WHEN hop = made THEN refused END), 'ok') AS verdict,
    coalesce(bool_and(host = fh AND (scheme = fs AND port IS NOT DISTINCT FROM fp OR fs = 'http' AND scheme = 'https' AND fp = 80 AND port = 443)) FILTER (hop < made), true) AS credentials FROM e GROUP BY request""")
def src12(t: Tables):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    n = (p * 2654435761 + s * 40503) % 4294967296
    dotted = F.concat_ws(".", *[(F.shiftright(n, b).bitwiseAND(F.lit(255))).cast("string") for b in (24, 16, 8, 0)])
    m, none = p % 8, F.array().cast("array<string>")
    resolved = F.when(m == 0, F.array(dotted)).when(m == 1, F.array(F.concat(F.lit("::ffff:"), dotted))).when(m == 2, F.array(dotted, F.concat(F.lit("2606:4700::"), F.lower(F.hex(s)))))
    resolved = resolved.when(m == 3, F.array(F.lit("fd00:ec2::254"))).when(m == 4, F.array(F.lit("FE80::1%eth0"))).when(m == 5, none).when(m == 6, F.array(F.concat(F.lit("10.0.0."), (s % 256).cast("string"))))
    resolved = resolved.otherwise(F.array(F.when(s % 2 == 1, "not an address").otherwise("2001:4860::8888")))
    scheme = F.when(p % 23 == 0, "ftp").when(p % 3 == 0, "http").otherwise("https")
    url = F.concat(scheme, F.lit("://h"), (s % 5).cast("string"), F.when(s % 2 == 0, ".Example:8443").otherwise(".example"), F.lit("/a?b=//c:1"))
    hop = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    hops = t.lineitem.select(F.col("l_orderkey").alias("request"), hop.alias("hop"), url.alias("url"), resolved.alias("addresses"))
    return checked_hops(hops, ALLOWED, most_redirects=3)
