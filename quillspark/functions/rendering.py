"""Blocks to Markdown: text cleaning, headings, boilerplate keys, block dispatch, label and value pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, stored
from .form_latex import flatten_forms

# Checkbox glyphs, label groups, pairing thresholds.
TICKED, EMPTY = "☒☑⊠", "□☐▢"
BOILERPLATE = ("header", "footer", "number")
QUOTED = ("header", "footer", "footnote", "aside_text", "reference")
PLAIN = ("text", "paragraph", "content")
VALUES = (*PLAIN, "inline_formula", "display_formula")
LEAST_OVERLAP, MOST_GAP = 0.5, 0.25


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def checkboxes(text: Column) -> Column:
    t = F.regexp_replace(text, r"\$\s*\\checkmark\s*\$", "[x]")
    return F.regexp_replace(F.regexp_replace(t, f"[{TICKED}]", "[x]"), f"[{EMPTY}]", "[ ]")


def boilerplate_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(clean(text)), r"\d+", "#")


def heading(cleaned: Column, level: int) -> Column:
    """A heading marker the text already has stays; otherwise ``level`` marks."""
    return F.when(cleaned.rlike(r"^#{1,6}\s+\S"), cleaned).otherwise(F.concat(F.lit("#" * level + " "), cleaned))


def block(label: Column, content: Column, page: Column) -> Column:
    """Markdown of one block, form fields and tables in HTML included; empty where it renders nothing."""
    figure = F.concat(F.lit("*[Figure on page "), page.cast("string"), F.lit("]*"))
    cleaned = clean(flatten_forms(checkboxes(F.coalesce(content, F.lit(""))))[0])
    return F.transform(F.array(cleaned), lambda c: dispatch(label, content, c, figure))[0]  # the array: cleaned once


def dispatch(label: Column, content: Column, c: Column, figure: Column) -> Column:
    return (
        F.when(label == "llm_markdown", F.trim(F.coalesce(content, F.lit(""))))
        .when(label.isin("figure", "image"), F.when(c == "", figure).otherwise(F.concat(figure, F.lit(" "), c)))
        .when(c == "", "")
        .when(label.isin("paragraph_title", "doc_title"), heading(c, 2))
        .when(label == "table_title", heading(c, 3))
        .when((label == "table") & F.lower(c).contains("<table"), gfm_table(table_rows(c)))
        .when(label.isin(*QUOTED), F.concat(F.lit("> "), c))
        .otherwise(c)
    )


def reading_order() -> list[Column]:
    """Blocks with an order first, by it; then by block id, a missing one last."""
    return [F.col("ord").isNull(), F.coalesce("ord", F.lit(10**9)), F.coalesce("block_id", F.lit(10**9)), F.col("pos")]


def rendered_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, ord, block_id, pos, label, content) with ``seq`` and ``rendered``; repeated boilerplate and empty ones go."""
    b = blocks.withColumn("rendered", block(F.col("label"), F.col("content"), F.col("page") + 1)).filter("rendered <> ''")
    b = b.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*reading_order())))
    key = F.when(F.col("label").isin(*BOILERPLATE), boilerplate_key(F.col("content")))
    first = F.row_number().over(Window.partitionBy("doc_id", "boiler").orderBy("page", "seq"))
    return b.withColumn("boiler", key).withColumn("nth", F.when(F.col("boiler").isNotNull(), first).otherwise(1)).filter("nth = 1").drop("boiler", "nth")


def assemble(rendered: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, markdown, block_count: pages in order, each under its page mark."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "rendered"))), lambda x: x["rendered"])
    page = rendered.groupBy("doc_id", "page").agg(parts.alias("parts"), F.count("*").alias("n")).join(pages, "doc_id")
    head = F.concat(F.lit("<!-- page:"), (F.col("page") + 1).cast("string"), F.lit("/"), F.col("n_pages").cast("string"), F.lit(" -->"))
    page = page.withColumn("body", F.array_join(F.concat(F.array(head), "parts"), "\n\n"))
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"])
    return page.groupBy("doc_id").agg(F.array_join(bodies, "\n\n---\n\n").alias("markdown"), F.sum("n").alias("block_count"))


def pair_candidates(blocks: DataFrame) -> DataFrame:
    """label_seq, value_seq, gap for every value a label may claim: right of it, on its line, near, no label between.

    blocks: doc_id, page, seq, label, rendered, x0, y0, x1, y1. The join is within a page.
    """
    b = blocks.withColumn("is_label", F.rtrim("rendered").endswith(":"))
    b = b.withColumn("width", F.max("x1").over(Window.partitionBy("doc_id", "page"))).filter("x0 IS NOT NULL")
    names = F.col("is_label") & F.col("label").isin(*PLAIN)

    def side(prefix: str, rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "page", *[F.col(c).alias(f"{prefix}_{c}") for c in ("seq", "x0", "y0", "x1", "y1")])

    labels = side("l", b.filter(names)).join(b.select("doc_id", "page", "width").distinct(), ["doc_id", "page"])
    values = side("v", b.filter(~F.col("is_label") & F.col("label").isin(*VALUES)))
    height = F.col("l_y1") - F.col("l_y0")

    def beside(p: str) -> Column:
        return F.least("l_y1", f"{p}_y1") - F.greatest("l_y0", f"{p}_y0") >= height * LEAST_OVERLAP

    gap = F.col("v_x0") - F.col("l_x1")
    near = labels.join(values, ["doc_id", "page"]).filter((height > 0) & (gap > 0) & beside("v") & (gap <= F.col("width") * MOST_GAP))
    other = side("m", b.filter(names))
    same_box = F.forall(F.array(*[F.col(f"m_{c}") == F.col(f"l_{c}") for c in ("x0", "y0", "x1", "y1")]), lambda x: x)
    between = (near["doc_id"] == other["doc_id"]) & (near["page"] == other["page"]) & ~same_box & (F.col("m_x0") >= F.col("l_x1")) & (F.col("m_x0") < F.col("v_x0")) & beside("m")
    free = near.join(other, between, "left_anti")
    return free.select("doc_id", "page", F.col("l_seq").alias("label_seq"), F.col("v_seq").alias("value_seq"), gap.alias("gap"))


def claim_pairs(candidates: DataFrame) -> DataFrame:
    """doc_id, page, label_seq, value_seq: labels in document order each take the nearest value that is still free.

    In rounds: a label takes its nearest value as soon as no earlier label could still want that value; what both held
    goes, and the rest decides anew. The first label left on a page always takes its value, and most take theirs at once, so
    rounds are few and each is joins and aggregates over all pages together; equal gaps go to the earlier value.
    """
    rest, won, page = stored(candidates.select("doc_id", "page", "label_seq", "value_seq", "gap")), None, ["doc_id", "page"]
    while rest.limit(1).count():
        nearest = rest.groupBy(*page, "label_seq").agg(F.min(F.struct("gap", "value_seq"))["value_seq"].alias("value_seq"))
        wanted = rest.groupBy(*page, "value_seq").agg(F.min("label_seq").alias("label_seq"))
        new = stored(nearest.join(wanted, [*page, "label_seq", "value_seq"]))
        won = new if won is None else won.unionByName(new)
        before, rest = rest, stored(rest.join(new, [*page, "label_seq"], "left_anti").join(new, [*page, "value_seq"], "left_anti").select(*rest.columns))
        forget(before)
    return (rest if won is None else won).select(*page, "label_seq", "value_seq")


def is_navigation(markdown: Column) -> Column:
    """Five links or more that hold at least 70 % of the characters; images are no links."""
    pattern = r"(?<!!)\[([^\]]*)\]\(([^)]+)\)"
    text = F.regexp_extract_all(markdown, F.lit(pattern), F.lit(1))
    target = F.regexp_extract_all(markdown, F.lit(pattern), F.lit(2))
    whole = F.length(F.regexp_replace(markdown, r"\s+", ""))
    held = F.length(F.regexp_replace(F.array_join(text, ""), r"\s+", "")) + F.length(F.array_join(target, ""))
    return (F.size(text) >= 5) & (held >= whole * 0.7)


def page_id(value: Column) -> Column:
    v = F.trim(value)
    return F.when(v.rlike("^[0-9]+$"), v).otherwise(
        F.coalesce(F.nullif(F.regexp_extract(v, r"[?&]pageId=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"/pages/(\d+)", 1), F.lit("")))
    )


def safe_filename(name: Column) -> Column:
    """Last path part without control characters and leading dots, white space as _, at most 200 with its extension."""
    base = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    n = F.trim(F.regexp_replace(F.trim(F.regexp_replace(base, r"[\x00-\x1f\x7f]", "")), r"^\.+", ""))
    n = F.regexp_replace(n, r"\s+", "_")
    ext = F.regexp_extract(n, r"\.([^.]{1,16})$", 1)
    stem = F.regexp_replace(n, r"\.[^.]*$", "")
    cut = F.when(ext != "", F.concat(F.rtrim(F.substring(stem, F.lit(1), F.lit(199) - F.length(ext)), F.lit(".")), F.lit("."), ext)).otherwise(F.substring(n, 1, 200))
    return F.coalesce(F.nullif(F.when(F.length(n) > 200, cut).otherwise(n), F.lit("")), F.lit("file"))


def strip_frontmatter(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"\A---\r?\n(?s:.*?)\r?\n---\r?\n?", "")


def breadcrumb(titles: Column) -> Column:
    return F.concat(F.lit("> Confluence: "), F.array_join(titles, " › "))


def rects(polygon: Column) -> Column:
    """x0, y0, x1, y1 of an array of points."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def table_rows(html: Column) -> Column:
    """Cells of an HTML table, row by row: tags stripped, bars escaped."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(
        F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)),
        lambda c: F.replace(clean(F.regexp_replace(c, r"<[^>]+>", "")), F.lit("|"), F.lit(r"\|")),
    ))


def gfm_table(rows: Column) -> Column:
    """A table with a header line, rows padded to the widest; empty without rows."""
    wide = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n")
    return F.when(F.size(rows) > 0, table).otherwise("")


