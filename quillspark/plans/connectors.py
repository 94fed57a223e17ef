"""Queries through data sources of the library: recorded wiki listings, result files that are replaced, folder archives."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder_path
from ..operators import visibility as V
from ..sources.archives import current, write_results
from ..sources.listings import read_listings, record, response
from ..storage import shared_folder
from ..streaming.runs import restarted
from .browse import PATH, VISIBLE
from .registry import Tables, query

# ------------------------------------------------------------------ listings: twenty pages each, four to a response

#: Every fifth listing each: whole; its second page links back to the first; its third is empty; whole by start; its second is short.
ENTRIES = """e AS (SELECT page_id, page_id // 20 AS k, page_id % 20 // 4 AS pg, page_id % 20 % 4 AS position FROM pages),
  kept AS (SELECT *, max(pg) OVER (PARTITION BY k) AS last FROM e WHERE k % 5 IN (0, 3) OR pg < 2 AND NOT (k % 5 = 4 AND pg = 1 AND position = 3))
  SELECT 'L' || k AS listing, CAST(pg AS INT) AS page, CAST(position AS INT) AS position, CAST(page_id AS VARCHAR) AS id FROM kept"""


def responses(t: Tables) -> DataFrame:
    p = F.col("page_id")
    k, pg = F.floor(p / 20).alias("k"), F.floor(p % 20 / 4).alias("pg")
    rows = t.pages.groupBy(k, pg).agg(F.sort_array(F.collect_list("page_id")).alias("ids"))  # four at most
    kind, listing = F.col("k") % 5, F.concat(F.lit("L"), F.col("k").cast("string"))

    def url(page):
        by = F.when(kind >= 3, F.concat(F.lit("?limit=4&start="), (page * 4).cast("string"))).otherwise(F.concat(F.lit("?cursor=c"), page.cast("string")))
        return F.concat(F.lit("https://wiki.example/"), listing, by)

    ids = F.when((kind == 2) & (F.col("pg") == 2), F.array().cast("array<long>")).when((kind == 4) & (F.col("pg") == 1), F.slice("ids", 1, 3)).otherwise(F.col("ids"))
    after = F.when(kind < 3, url(F.when((kind == 1) & (F.col("pg") == 1), F.lit(0)).otherwise(F.col("pg") + 1)))
    return rows.select(listing.alias("listing"), F.when(kind >= 3, "start").otherwise("cursor").alias("mode"), url(F.col("pg")).alias("url"), (F.col("pg") == 0).alias("first"), response(ids, after).alias("body"))


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("src9_listing_reader", f"WITH {ENTRIES}")
def src9_reader(t: Tables):
    """Listings followed by cursor or by start, to a seen address, an empty or a short page."""
    at = _folder(t, "responses")
    record(responses(t), at)
    return read_listings(t.spark, at, limit=4).select("listing", "page", "position", "id")


@query("src9_listing_stream", f"WITH {ENTRIES}")
def src9_stream(t: Tables):
    """The same as a stream: odd listings are recorded while it is down, and it resumes at its offset."""
    at, rows = _folder(t, "responses"), responses(t)
    odd = F.substring("listing", 2, 20).cast("long") % 2 == 1
    steps = [lambda: record(rows.filter(~odd), at), lambda: record(rows.filter(odd), at)]
    return restarted(t.spark, lambda: read_listings(t.spark, at, limit=4, stream=True).select("listing", "page", "position", "id"), steps)


# ------------------------------------------------------------------ sinks


def result_path() -> Column:
    return F.concat(F.coalesce("storage_folder", F.lit("inbox")), F.lit("/"), F.col("job_id").cast("string"), F.lit(".md"))


@query("snk1_results_replaced", """SELECT coalesce(storage_folder, 'inbox') || '/' || job_id || '.md' AS path, CASE WHEN job_id % 3 = 0 OR markdown IS NULL THEN 'draft of ' || job_id ELSE markdown END AS markdown
  FROM jobs WHERE status = 'FINISHED'""")
def snk1_replaced(t: Tables):
    """Files as they stand after every finished job was written and some were written again."""
    at = _folder(t, "results")
    jobs = t.jobs.filter("status = 'FINISHED'").withColumn("path", result_path())
    write_results(jobs.select("path", F.concat(F.lit("draft of "), F.col("job_id").cast("string")).alias("markdown")), at)
    again = jobs.filter("job_id % 3 <> 0 AND markdown IS NOT NULL").select("path", "markdown")
    write_results(again, at)
    write_results(again, at)  # a rerun changes nothing
    return current(t.spark, at)


#: A job's folder below the exported one, its file name's stem, its id.
MEMBER = "coalesce(nullif(ltrim(substr(path, 3), '/'), '') || '/', '') || regexp_replace(filename, '[.][^.]*$', '') || '-' || job_id || '.md'"


@query("snk2_archive", f"""WITH {VISIBLE}, j AS (SELECT job_id, owner_id, filename, status, markdown, {PATH} AS path FROM jobs)
  SELECT {MEMBER} AS path, markdown FROM j WHERE status = 'FINISHED' AND markdown IS NOT NULL AND job_id % 17 <> 0 AND (path = 'F1' OR path LIKE 'F1/%')
    AND owner_id IN (SELECT owner_id FROM owners WHERE viewer_id = 7)""")
def snk2_archive(t: Tables):
    """What viewer 7 gets for folder F1: visible finished jobs without a password (one in 17 has one), from the shards written."""
    at = _folder(t, "archive")
    jobs = V.visible(t.jobs, t.users, 7).withColumn("path", folder_path(F.col("folder"), F.col("subfolder"), F.col("storage_folder")))
    jobs = jobs.filter(V.in_folder(F.col("path"), "F1") & (F.col("status") == "FINISHED") & F.col("markdown").isNotNull() & (F.col("job_id") % 17 != 0))
    below = F.nullif(F.ltrim(F.substr("path", F.lit(3)), F.lit("/")), F.lit(""))
    name = F.concat(F.coalesce(F.concat(below, F.lit("/")), F.lit("")), F.regexp_replace("filename", "[.][^.]*$", ""), F.lit("-"), F.col("job_id").cast("string"), F.lit(".md"))
    write_results(jobs.select(name.alias("path"), "markdown"), at)
    return current(t.spark, at)
