"""Paged listings of a wiki as a data source, in batch and as a stream, over recorded responses.

``record`` deals responses to batches: all responses of one listing lie in one file, so a file is a partition that reads
alone. Each listing is followed from its first address: by the ``next`` link of each response (mode ``cursor``), or by
raising ``start`` in the address by ``limit`` (mode ``start``). A reader stops at a page without results, at an address
it has seen, at one that was not recorded, after ``most_items``, and in mode ``start`` at a page shorter than ``limit``.
Entries of another type than ``page`` and those without an id are passed over.

As a stream the offset is the number of batches read: a restart goes on with the next one, and a batch that was planned
but not committed is read again, whole.

Defined results: null or malformed bodies end their listing; repeated addresses keep one body (the greatest); an empty
folder gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .remote import names, opened

START = re.compile(r"([?&])start=(\d+)")


def record(responses: DataFrame, path: str, files: int | None = None) -> None:
    """Add a batch of responses: listing, mode, url, first (is it the listing's first address), body."""
    batch = len(names(path))
    rows = responses.select("listing", "mode", "url", "first", "body")
    rows = rows.repartition(files, "listing") if files else rows.repartition("listing")
    rows.write.parquet(f"{path.rstrip('/')}/batch-{batch:08d}")


def follow(first: str, mode: str, bodies: dict[str, str | None], limit: int, most_items: int) -> Iterator[tuple[int, int, str, str]]:
    """page, position, id and the entry's JSON, for the entries of one listing."""
    url, seen, page, given = first, set(), 0, 0
    while url is not None and url not in seen and url in bodies:
        seen.add(url)
        try:
            data = json.loads(bodies[url] or "")
        except ValueError:
            return
        results = data.get("results") if isinstance(data, dict) else None
        if not isinstance(results, list) or not results:
            return
        for at, item in enumerate(results):
            if isinstance(item, dict) and item.get("type", "page") == "page" and str(item.get("id") or ""):
                yield page, at, str(item["id"]), json.dumps(item, sort_keys=True)
                given += 1
                if given >= most_items:
                    return
        if mode == "start":
            m = START.search(url) if len(results) >= limit else None
            url = f"{url[: m.start()]}{m[1]}start={int(m[2]) + limit}{url[m.end() :]}" if m else None
        else:
            links = data.get("_links")
            url = links.get("next") if isinstance(links, dict) else None
        page += 1


@dataclass
class RecordedFile(InputPartition):
    uri: str


class _Reading:
    def __init__(self, options: dict):
        self._path, self._limit, self._most = options["path"].rstrip("/"), int(options.get("limit", 50)), int(options.get("most_items", 1000))

    def _files(self, batches: list[str]) -> list[InputPartition]:
        return [RecordedFile(f"{self._path}/{b}/{f}") for b in batches for f in names(f"{self._path}/{b}") if f.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        if not isinstance(partition, RecordedFile):  # what Spark passes where there are none
            return
        system, path = opened(partition.uri)
        bodies: dict[str, dict[str, str | None]] = {}
        firsts: dict[str, tuple[str, str]] = {}
        for r in pq.read_table(path, filesystem=system).to_pylist():
            known = bodies.setdefault(r["listing"], {})
            known[r["url"]] = max(known.get(r["url"]) or "", r["body"] or "")
            if r["first"]:
                firsts[r["listing"]] = min(firsts.get(r["listing"], (r["url"], r["mode"])), (r["url"], r["mode"]))
        for listing, (url, mode) in firsts.items():
            for row in follow(url, mode, bodies[listing], self._limit, self._most):
                yield listing, *row


class ListingReader(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._files(names(self._path))


class ListingStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": len(names(self._path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._files(names(self._path)[start["batches"] : end["batches"]])

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    """``spark.read.format("paged_listing").load(path)``; options limit (50) and most_items (1000)."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "listing string, page int, position int, id string, item string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStream(self.options)


def read_listings(spark: SparkSession, path: str, limit: int = 50, most_items: int = 1000, stream: bool = False) -> DataFrame:
    spark.dataSource.register(PagedListing)
    how = spark.readStream if stream else spark.read
    return how.format("paged_listing").option("limit", limit).option("most_items", most_items).load(path)


def response(ids: Column, next_url: Column) -> Column:
    """A response body: entries of type page with these ids, and the link to the next page where there is one."""
    entries = F.transform(ids, lambda i: F.struct(i.cast("string").alias("id"), F.lit("page").alias("type")))
    return F.to_json(F.struct(entries.alias("results"), F.struct(next_url.alias("next")).alias("_links")))
