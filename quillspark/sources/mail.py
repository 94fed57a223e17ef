"""Raw mails as a table: envelope, body choice and part manifest, each a pure function of the bytes.

``read_mails`` reads files; ``parsed`` works on any table with a binary column. One Arrow pass, no shuffle; the raw
bytes are not carried into the result.
"""

from __future__ import annotations

import email.policy
import mimetypes
import re
from collections.abc import Iterator
from email.message import EmailMessage
from email.parser import BytesParser
from email.policy import EmailPolicy
from functools import lru_cache
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import MARKDOWN_CHARS, frontmatter
from ..functions.wiki import markdown_of
from .uploads import EXTENSIONS, MOST_BYTES

# Declared types that say nothing, and those that fit an extension.
GENERIC = ("", "application/octet-stream", "binary/octet-stream")
TYPES = {
    ".pdf": ("application/pdf",),
    ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    ".pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation",),
    ".xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
    ".xls": ("application/vnd.ms-excel",),
    ".png": ("image/png",),
    ".jpg": ("image/jpeg",),
    ".jpeg": ("image/jpeg",),
    ".eml": ("message/rfc822",),
}
KNOWN_TYPES = frozenset(t for ts in TYPES.values() for t in ts)

SCHEMA = (
    "sha256 string, subject string, from_address string, to_list array<string>, cc_list array<string>, sent_at timestamp, message_id string, "
    "body_type string, body string, parts array<struct<index: int, filename: string, content_type: string, size_bytes: bigint, outcome: string, skip_reason: string>>"
)


class Remembered(EmailPolicy):
    """The default policy, which parses a header at each look at it; here the parsed ones, which nothing changes, are kept."""

    def header_fetch_parse(self, name: str, value: str):
        if hasattr(value, "name") or len(value) > 1000:
            return email.policy.default.header_fetch_parse(name, value)
        return _header(name, value)


@lru_cache(4096)
def _header(name: str, value: str):
    return email.policy.default.header_fetch_parse(name, value)


POLICY = Remembered()


def addresses(message: EmailMessage, name: str) -> list[str]:
    header = message.get(name)
    return [a.addr_spec for a in getattr(header, "addresses", ()) if a.addr_spec]


def sent_at(message: EmailMessage):
    """The date header in UTC; null where it is missing or unreadable, a naive one counts as UTC."""
    try:
        at = message["Date"].datetime
    except (AttributeError, TypeError, ValueError):
        return None
    return None if at is None else pd.Timestamp(at).tz_localize("UTC") if at.tzinfo is None else pd.Timestamp(at).tz_convert("UTC")


def size_of(part: EmailMessage) -> int:
    inner = part.get_payload()
    if part.get_content_type() == "message/rfc822":
        return len(inner[0].as_bytes()) if isinstance(inner, list) and inner else 0
    data = part.get_payload(decode=True)
    return len(data) if isinstance(data, bytes) else 0


def leaves(message: EmailMessage) -> Iterator[tuple[EmailMessage, str | None]]:
    """Parts in document order with a reason where a container is kept closed; the chosen body and its other renderings are left out."""
    body = message.get_body(preferencelist=("html", "plain"))
    waiting: list[EmailMessage] = [message]
    while waiting:
        part = waiting.pop()
        if part is body:
            continue
        if part.get_content_type() == "message/rfc822":
            yield part, "nested_message"
        elif part.get_content_maintype() != "multipart":
            yield part, None
        else:
            inside = part.get_payload()
            if not isinstance(inside, list) or not inside:
                yield part, "unsupported_container"
                continue
            if body is not None and part.get_content_subtype() == "alternative":
                inside = [p for p in inside if p is body or p.get_content_type() not in ("text/plain", "text/html")]
            waiting += reversed(inside)


def outcome(part: EmailMessage, filename: str, size: int) -> tuple[str, str | None]:
    """job, inline or skipped with a reason."""
    if part.get_content_disposition() == "inline" and (part.get("Content-ID") or "").strip(" <>"):
        return "inline", None
    ext, declared = PurePosixPath(filename).suffix.lower(), part.get_content_type().lower()
    if ext not in EXTENSIONS or not (declared in GENERIC or declared in KNOWN_TYPES or declared in TYPES.get(ext, ())):
        return "skipped", "unsupported_type"
    return ("skipped", "too_large") if size > MOST_BYTES else ("job", None)


def manifest(message: EmailMessage) -> list[dict]:
    out = []
    for i, (part, closed) in enumerate(leaves(message)):
        kind, size = part.get_content_type(), size_of(part)
        given = (part.get_filename() or "").replace("\\", "/").rsplit("/", 1)[-1].strip().lstrip(".")
        name = "_".join(given.split()) or f"part-{i}{mimetypes.guess_extension(kind) or '.bin'}"
        verdict = ("skipped", closed) if closed else outcome(part, name, size)
        out.append({"index": i, "filename": name, "content_type": kind, "size_bytes": size, "outcome": verdict[0], "skip_reason": verdict[1]})
    return out


CID_IMAGE = re.compile(r"""<img\b[^>]*?\bsrc\s*=\s*["']?\s*cid:([^"'\s>]*)[^>]*>""", re.IGNORECASE)


def with_names(html: str, message: EmailMessage, parts: list[dict]) -> str:
    """Images that point into the mail become the names of the parts they show."""
    if "cid:" not in html.lower():
        return html
    names = {}
    for (part, _), row in zip(leaves(message), parts, strict=True):
        key = (part.get("Content-ID") or "").strip(" <>")
        if row["outcome"] == "inline" and key:
            names[key] = ": " + re.sub(MARKDOWN_CHARS, r"\\\1", row["filename"])
    return CID_IMAGE.sub(lambda m: f"![inline attachment{names.get(m[1].strip(' <>'), '')}]", html)


def parse(raw: bytes) -> tuple:
    message = BytesParser(policy=POLICY).parsebytes(raw or b"")
    sender, body = addresses(message, "From"), message.get_body(preferencelist=("html", "plain"))
    text = None
    if body is not None:
        content = body.get_content()
        text = content if isinstance(content, str) else content.decode("utf-8", "replace")
    parts = manifest(message)
    if text is not None and body.get_content_type() == "text/html":
        text = with_names(text, message, parts)
    return (
        str(message.get("Subject") or "").strip(), sender[0] if sender else str(message.get("From") or "").strip(), addresses(message, "To"), addresses(message, "Cc"), sent_at(message),
        str(message.get("Message-ID") or "").strip() or None, None if body is None else body.get_content_type(), text, parts,
    )


def parsed(mails: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """id and the parsed columns; equal bytes get equal results, null bytes an empty message."""
    rows = mails.select(F.col(id_col).cast("string").alias("id"), F.sha2(raw_col, 256).alias("sha256"), F.col(raw_col).alias("raw"))
    names = ["subject", "from_address", "to_list", "cc_list", "sent_at", "message_id", "body_type", "body", "parts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([parse(bytes(r) if r is not None else b"") for r in pdf["raw"]], columns=names)
            got["sent_at"] = pd.to_datetime(got["sent_at"], utc=True)
            yield pd.concat([pdf[["id", "sha256"]].reset_index(drop=True), got], axis=1)

    kind = mails.schema[id_col].dataType.simpleString()
    out = rows.mapInPandas(run, f"id string, {SCHEMA}")
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])


def rendered(mails: DataFrame) -> DataFrame:
    """``markdown`` beside the parsed columns: HTML written as Markdown, plain text as it is, null without a body."""
    html = F.col("body_type") == "text/html"
    return mails.withColumn("markdown", F.when(html, markdown_of(F.when(html, F.col("body")), F.lit(""))).otherwise(F.col("body")))


def utc(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def with_envelope(mails: DataFrame, ingested_by: Column) -> DataFrame:
    """``document``: the envelope as frontmatter, then the rendered body; null without a body."""
    fields = [
        ("source", F.lit("mail"), False), ("subject", F.col("subject"), False), ("from", F.col("from_address"), False), ("to", F.col("to_list"), False), ("date", utc(F.col("sent_at")), False),
        ("message_id", F.col("message_id"), False), ("content_sha256", F.col("sha256"), False), ("ingested_by", ingested_by, False),
    ]
    return rendered(mails).withColumn("document", F.concat(frontmatter(fields), "markdown"))


def manifests(mails: DataFrame, id_col: str) -> DataFrame:
    """One row a part."""
    return mails.select(id_col, F.explode("parts").alias("p")).select(id_col, "p.*")


def as_documents(mails: DataFrame, id_col: str, converted: DataFrame) -> DataFrame:
    """id, markdown, page_count: the body, then each attachment's own Markdown or why there is none, in the mail's order.

    ``converted``: id_col, index, markdown, pages of the attachments; one that is missing there could not be converted.
    Inline parts are left out. The join is on mail and part, so a mail with many parts is spread.
    """
    none = F.lit(None).cast("string")
    own = F.struct(F.lit(-1).alias("index"), none.alias("filename"), F.lit("body").alias("outcome"), none.alias("skip_reason"), F.regexp_replace("markdown", r"^\s+|\s+$", "").alias("text"))
    rest = F.transform("parts", lambda p: F.struct(p["index"].alias("index"), p["filename"].alias("filename"), p["outcome"].alias("outcome"), p["skip_reason"].alias("skip_reason"), none.alias("text")))
    pieces = rendered(mails).select(id_col, F.explode(F.concat(F.array(own), rest)).alias("p")).select(id_col, "p.*").filter("outcome <> 'inline'")
    found = converted.select(id_col, "index", F.trim("markdown").alias("inner"), F.coalesce("pages", F.lit(0)).cast("long").alias("n_pages"))
    j = pieces.join(found, [id_col, "index"], "left")
    said = lambda why: F.concat(F.lit("(skipped: "), "filename", F.lit(" — "), why, F.lit(")"))
    job = F.when(F.col("inner").isNull(), said(F.lit("conversion error"))).when(F.col("inner") != "", F.concat(F.lit("## Attachment: "), "filename", F.lit("\n\n"), "inner"))
    section = F.when(F.col("outcome") == "body", F.col("text")).when(F.col("outcome") == "job", job).otherwise(said(F.col("skip_reason")))
    every = j.select(id_col, "index", section.alias("section"), F.when(F.col("outcome") == "job", F.coalesce("n_pages", F.lit(0))).otherwise(0).cast("long").alias("pages"))
    listed = F.sort_array(F.collect_list(F.when(F.col("section") != "", F.struct("index", "section"))))
    joined = F.array_join(F.transform(listed, lambda s: s["section"]), "\n\n---\n\n")
    out = every.groupBy(id_col).agg(joined.alias("markdown"), F.greatest(F.lit(1).cast("long"), F.sum("pages")).alias("page_count"))
    return out.withColumn("markdown", F.when(F.col("markdown") == "", "(empty email)").otherwise(F.col("markdown")))


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path)
    return parsed(files.filter(F.col("length") <= MOST_BYTES), "path", "content")
