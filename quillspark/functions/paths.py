"""Folder paths, file names and other small text functions, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """Back slashes to slashes, trimmed parts, no empty ones; null where a part is . or .. or holds NUL."""
    parts = F.filter(F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: F.trim(x)), lambda x: x != "")
    bad = F.exists(parts, lambda x: x.isin(".", "..") | x.contains("\0"))
    return F.when(~bad, F.array_join(parts, "/"))


def folder_path(folder: Column, subfolder: Column, storage: Column) -> Column:
    """folder/subfolder, else the storage folder without its last segment, else ``inbox``."""
    own = F.nullif(clean_path(F.concat_ws("/", folder, subfolder)), F.lit(""))
    parts = F.split(storage, "/")
    kept = F.nullif(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"), F.lit(""))
    return F.coalesce(own, kept, F.lit("inbox"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def slug(title: Column, most: int = 80) -> Column:
    plain = F.lower(F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(F.substring(plain, 1, most), F.lit("")), F.lit("page"))


def tag_list(raw: Column) -> Column:
    """Comma or line separated tags: trimmed, lower case, first occurrences in order."""
    parts = F.transform(F.split(F.regexp_replace(raw, "\n", ","), ","), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def byte_size(n: Column) -> Column:
    """1024-ladder: whole bytes, else one decimal, exact halves to the even tenth (as C and Python print them, unlike Java)."""
    n = n.cast("long")
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB")):
        step = F.lit(1024 ** (i + 1)).cast("long")
        tenths = F.call_function("div", n, step) * 10 + F.call_function("div", n % step * 10, step)
        twice = n % step * 10 % step * 2
        tenths = tenths + ((twice > step) | (twice == step) & (tenths % 2 == 1)).cast("long")
        shown = F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.when(n < step * 1024, shown) if unit != "GB" else out.otherwise(shown)
    return out


def is_generic_mime(declared: Column, expected: Column) -> Column:
    """A declared type passes when empty, generic, as expected, or of the same top-level kind."""
    d = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    return (d == "") | (d == "application/octet-stream") | (d == expected) | (F.split_part(d, F.lit("/"), F.lit(1)) == F.split_part(expected, F.lit("/"), F.lit(1)))
