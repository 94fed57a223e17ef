"""Names, addresses, frontmatter and signatures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Claims in order of priority, characters with a meaning in Markdown, media types shown inline.
EMAIL_CLAIMS = ("email", "upn", "unique_name", "preferred_username")
MARKDOWN_CHARS = r"([\\`\[\]()#<>])"
INLINE_TYPES = ("image/png", "image/jpeg", "image/gif", "image/webp", "application/pdf")
HEADER_MARKS = ("[x]", "[ ]")
ICD_PARTS = r"\b([A-TV-Z])\s*([0-9])\s*([0-9])\s*[.]\s*([0-9]{1,2})\b"


def usable_email(value: Column) -> Column:
    return F.when(value.contains("@") & ~value.contains("\\"), value)


def resolved_email(claims: dict[str, Column]) -> Column:
    return F.coalesce(*[usable_email(claims[k]) for k in EMAIL_CLAIMS if k in claims])


def username_base(claims: dict[str, Column]) -> Column:
    """preferred_username, else a upn or unique_name with an @, else the name, else the local part of the address, else sub."""
    given = lambda k: F.when(claims[k] != "", claims[k])
    upn = F.when(claims["upn"].contains("@"), claims["upn"])
    return F.coalesce(given("preferred_username"), upn, usable_email(claims["unique_name"]), given("name"), F.substring_index(resolved_email(claims), "@", 1), claims["sub"])


def escaped_markdown(text: Column) -> Column:
    return F.regexp_replace(text, MARKDOWN_CHARS, r"\\$1")


def content_id(value: Column) -> Column:
    """Without angle brackets and blanks; null when nothing is left."""
    bare = F.regexp_replace(value, r"^[\s<>]+|[\s<>]+$", "")
    return F.when(bare != "", bare)


def cid_placeholder(filename: Column) -> Column:
    return F.when(filename.isNotNull(), F.concat(F.lit("![inline attachment: "), escaped_markdown(filename), F.lit("]"))).otherwise("![inline attachment]")


def content_disposition(filename: Column, kind: str = "attachment") -> Column:
    """A quoted ASCII fallback and the UTF-8 name, percent-encoded."""
    plain = F.regexp_replace(filename, r'[^\x20-\x7e]|["\\]', "_")
    fallback = F.when(plain == "", "download").otherwise(plain)
    encoded = F.replace(F.replace(F.replace(F.url_encode(filename), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f'{kind}; filename="'), fallback, F.lit("\"; filename*=UTF-8''"), encoded)


def base_url(raw: Column) -> Column:
    """scheme://host[:port]/path without a slash at the end; null for another scheme, no host, credentials, query or fragment."""
    value = F.trim(raw)
    return F.when(value.rlike(r"^https?://[^/?#@\s]+[^?#]*$") & ~value.rlike(r"^https?://[^/]*@"), F.regexp_replace(value, "/+$", ""))


def host_key(url: Column) -> Column:
    """host:port in lower case, with the scheme's own port where none is given."""
    host = F.lower(F.regexp_extract(url, r"^\w+://([^/:?#]+)", 1))
    port = F.regexp_extract(url, r"^\w+://[^/:?#]+:(\d+)", 1)
    own = F.when(F.lower(F.regexp_extract(url, r"^(\w+)://", 1)) == "https", "443").otherwise("80")
    return F.concat(host, F.lit(":"), F.when(port != "", port).otherwise(own))


def frontmatter(fields: list[tuple[str, Column, bool]]) -> Column:
    """--- block of ``key: value`` lines in a fixed order. (key, value, optional): an optional null leaves its line out, another is
    null. Values are written as JSON scalars, which YAML reads as they are, so no value can close the block."""
    lines = []
    for key, value, optional in fields:
        text = F.when(value.isNull(), F.lit(f"{key}: null")).otherwise(F.concat(F.lit(f"{key}: "), json_scalar(value)))
        lines.append(F.when(value.isNotNull(), text) if optional else text)
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def json_scalar(value: Column) -> Column:
    """A value as JSON: what to_json writes between the brackets of an array."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def with_frontmatter(block: Column, body: Column) -> Column:
    """The block, one blank line, the body; a block alone where the body is empty. No further fence between them."""
    return F.when(F.coalesce(body, F.lit("")) == "", F.trim(F.regexp_replace(block, r"\s+$", ""))).otherwise(F.regexp_replace(F.concat(F.regexp_replace(block, r"\n+$", ""), F.lit("\n\n"), body), r"\s+$", ""))


def with_key(markdown: Column, key: str, value: Column) -> Column:
    """``key`` added as the last line of the text's block unless the block has it; a text without a block stays as it is."""
    has_block = markdown.rlike(r"(?s)\A---\n.*?\n---\n")
    block = F.regexp_extract(markdown, r"(?s)\A(---\n.*?\n)---\n", 1)
    rest = F.regexp_replace(markdown, r"(?s)\A---\n.*?\n(?=---\n)", "")
    return F.when(has_block & ~block.rlike(rf"(?m)^{key}:"), F.concat(block, F.lit(f"{key}: "), json_scalar(value), F.lit("\n"), rest)).otherwise(markdown)


def rejoined_icd(text: Column) -> Column:
    return F.regexp_replace(text, ICD_PARTS, "$1$2$3.$4")


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """``sha256=<hex>`` over the UTF-8 bytes of ``message``, from two SHA-256 rounds over padded keys."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ pad for x in key).hex())) for pad in (0x36, 0x5C))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256))


def header_row(rows: Column, has_th: Column) -> Column:
    """Is the first row a header: marked as one, or all other rows hold only option marks or blanks behind their first cell?"""
    others, width = F.slice(rows, 2, 1_000_000), F.size(rows[0])
    cells = F.flatten(F.transform(others, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(width - 1, F.lit(1))), lambda i: F.trim(F.coalesce(F.get(r, i), F.lit(""))))))
    options = F.forall(cells, lambda c: c.isin("", *HEADER_MARKS)) & F.exists(cells, lambda c: c.isin("", *HEADER_MARKS))
    return has_th | F.when((F.size(rows) < 2) | (width < 2), False).otherwise(options)


def usable_box(box: Column, polygon: Column) -> Column:
    """flat for four numbers or more, polygon for three points or more of two numbers, else none."""
    flat = F.size(box) >= 4
    points = (F.size(polygon) >= 3) & F.forall(polygon, lambda p: F.size(p) >= 2)
    return F.when(F.coalesce(flat, F.lit(False)), "flat").when(F.coalesce(points, F.lit(False)), "polygon").otherwise("none")
