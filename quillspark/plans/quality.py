"""Quality scores and field checks over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import validation as V
from .registry import Tables, query

TOK = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
NOISE = rf"""tk AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS c FROM documents),
  t2 AS (SELECT doc_id, c, regexp_extract_all(c, '{TOK.replace("'", "''")}') AS tok, list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS li FROM tk),
  n AS (SELECT doc_id, c, len(tok) AS n_tokens, len(list_distinct(list_transform(tok, lambda x: lower(x)))) AS n_unique, len(li) AS n_lines, len(list_distinct(li)) AS n_unique_lines,
    length(regexp_replace(c, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS n_symbols,
    len(list_filter(tok, lambda x: CASE WHEN regexp_replace(lower(x), '[^\p{{L}}]', '', 'g') = '' THEN length(x) >= 6 AND NOT regexp_matches(x, '^[0-9]+$')
      ELSE (length(regexp_replace(lower(x), '[^\p{{L}}]', '', 'g')) >= 7 AND NOT regexp_matches(lower(x), '[aeiou]')) OR (length(x) >= 6 AND len(list_distinct(string_split(lower(x), ''))) <= 2) END)) AS n_gibberish FROM t2),
  s AS (SELECT *, CASE WHEN c = '' THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE * coalesce(1 - n_unique::DOUBLE / nullif(n_tokens, 0), 0) + 0.25::DOUBLE * coalesce(1 - n_unique_lines::DOUBLE / nullif(n_lines, 0), 0)
    + 0.2::DOUBLE * n_symbols / greatest(length(c), 1) + 0.2::DOUBLE * coalesce(n_gibberish::DOUBLE / nullif(n_tokens, 0), 0))) END AS noise FROM n)"""


@query("qg3_noise", f"WITH {NOISE} SELECT doc_id, CAST(n_tokens AS INT) AS n_tokens, CAST(n_unique AS INT) AS n_unique, CAST(n_lines AS INT) AS n_lines, CAST(n_symbols AS INT) AS n_symbols, round(noise, 6) AS noise FROM s")
def qg3(t: Tables):
    return Q.noise(t.documents.select("doc_id", "text")).select("doc_id", "n_tokens", "n_unique", "n_lines", "n_symbols", F.round("noise", 6).alias("noise"))


@query("qg4_gibberish", f"WITH {NOISE} SELECT doc_id, CAST(n_gibberish AS INT) AS n_gibberish FROM s WHERE n_gibberish > 0")
def qg4(t: Tables):
    return Q.noise(t.documents.select("doc_id", "text")).filter("n_gibberish > 0").select("doc_id", "n_gibberish")


BLOCKS = """blocks AS (SELECT conv_id AS doc_id, turn // 2 AS page, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn END AS ord,
    CASE (conv_id + turn) % 9 WHEN 0 THEN 'table' WHEN 1 THEN 'display_formula' WHEN 2 THEN 'header' WHEN 3 THEN 'paragraph_title' ELSE 'text' END AS label,
    CASE WHEN (conv_id * 3 + turn) % 4 = 0 THEN '' ELSE text END AS content FROM conversations)"""
STRUCTURE = f"""{BLOCKS}, p AS (SELECT doc_id, 1 + max(page) + doc_id % 2 AS n_pages FROM blocks GROUP BY doc_id),
  b AS (SELECT doc_id, count(DISTINCT page) AS filled, count(*) AS n, count(ord) AS ordered, count(*) FILTER (label = 'table') AS tabs, count(*) FILTER (label = 'table' AND trim(content) <> '') AS fullt, count(*) FILTER (label LIKE '%formula%') AS formulas FROM blocks GROUP BY doc_id),
  st AS (SELECT doc_id, least(1.0::DOUBLE, 0.40::DOUBLE * (filled / n_pages) + 0.25::DOUBLE * (ordered / n) + 0.20::DOUBLE * CASE WHEN tabs > 0 THEN fullt / tabs ELSE 1.0::DOUBLE END
    + 0.15::DOUBLE * (1 - least(1.0::DOUBLE, (formulas / n) / 0.1::DOUBLE))) AS structure FROM p JOIN b USING (doc_id))"""


def blocks(t: Tables):
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = (conv + turn) % 9
    label = F.when(kind == 0, "table").when(kind == 1, "display_formula").when(kind == 2, "header").when(kind == 3, "paragraph_title").otherwise("text")
    return t.conversations.select(
        conv.alias("doc_id"), F.expr("turn div 2").alias("page"), F.when(turn % 3 != 0, turn).alias("ord"), label.alias("label"),
        F.when((conv * 3 + turn) % 4 == 0, "").otherwise(F.col("text")).alias("content"), turn.alias("pos"),
    )


def structure(t: Tables):
    b = blocks(t)
    pages = b.groupBy("doc_id").agg((1 + F.max("page") + F.col("doc_id") % 2).alias("n_pages"))
    return Q.structure_score(b, pages)


@query("qg2_structure", f"WITH {STRUCTURE} SELECT doc_id, round(structure, 6) AS structure FROM st")
def qg2(t: Tables):
    return structure(t).select("doc_id", F.round("structure", 6).alias("structure"))


CONF = "cf AS (SELECT user_id AS doc_id, 0.5::DOUBLE * avg(v) + 0.5::DOUBLE * avg(CASE WHEN v >= 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS confidence, count(*) AS n FROM (SELECT user_id, (event_id % 120) / 100.0::DOUBLE AS v FROM events WHERE event_type <> 'view') WHERE v BETWEEN 0 AND 1 GROUP BY user_id)"


def confidences(t: Tables):
    return Q.confidence(t.events.filter("event_type <> 'view'").select(F.col("user_id").alias("doc_id"), ((F.col("event_id") % 120) / 100.0).alias("value")))


@query("agg13_confidence", f"WITH {CONF} SELECT doc_id, round(confidence, 6) AS confidence, n FROM cf")
def agg13(t: Tables):
    return confidences(t).select("doc_id", F.round("confidence", 6).alias("confidence"), "n")


@query(
    "qg5_gate",
    f"""WITH {NOISE}, {STRUCTURE}, {CONF}, g AS (SELECT doc_id, (coalesce(confidence * 0.5::DOUBLE, 0) + coalesce(structure * 0.3::DOUBLE, 0) + CASE WHEN c <> '' THEN (1 - noise) * 0.2::DOUBLE ELSE 0 END)
      / nullif(CASE WHEN confidence IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END + CASE WHEN structure IS NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN c <> '' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 0) AS score
      FROM s LEFT JOIN st USING (doc_id) LEFT JOIN cf USING (doc_id))
    SELECT doc_id, round(coalesce(score, 0), 4) AS score, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.75 THEN 'B' ELSE 'C' END AS grade, CASE WHEN score >= 0.9 THEN 'allow' WHEN score >= 0.75 THEN 'warn' ELSE 'block' END AS recommendation FROM g""",
)
def qg5(t: Tables):
    n = Q.noise(t.documents.select("doc_id", "text"))
    j = n.join(structure(t), "doc_id", "left").join(confidences(t), "doc_id", "left")
    text = F.when(F.col("text").rlike(r"\S"), 1 - F.col("noise"))
    j = j.withColumn("score", Q.gate_score(F.col("confidence"), F.col("structure"), text))
    grade, advice = Q.gate(F.col("score"))
    return j.select("doc_id", F.round("score", 4).alias("score"), grade.alias("grade"), advice.alias("recommendation"))


@query("agg11_block_stats", f"WITH {BLOCKS} SELECT label, count(*) AS n, count(DISTINCT doc_id) AS docs, count(*) FILTER (content <> '') AS filled FROM blocks GROUP BY label")
def agg11(t: Tables):
    return blocks(t).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.count_if(F.col("content") != "").alias("filled"))


IBANS = """cand AS (SELECT s_suppkey AS item_id, CASE s_suppkey % 6 WHEN 0 THEN 'DE89 3704 0044 0532 0130 00' WHEN 1 THEN 'DE88 3704 0044 0532 0130 00' WHEN 2 THEN 'OE45 1234 5678 9012' WHEN 3 THEN 'DE29@334550122257'
    WHEN 4 THEN 'GB82 WEST 1234 5698 7654 32' ELSE 'FR14 ' || CAST(s_suppkey AS STRING) || '0000' END || ' end' AS line FROM supplier)"""


@query(
    "val1_iban",
    f"""WITH {IBANS}, x AS (SELECT item_id, unnest(regexp_extract_all(line, '{V.IBAN}')) AS raw FROM cand), y AS (SELECT item_id, raw, upper(regexp_replace(raw, '[ \t]', '', 'g')) AS c FROM x),
    z AS (SELECT *, list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr(c, 5) || left(c, 4), ''), lambda k: CASE WHEN regexp_matches(k, '[0-9]') THEN k ELSE CAST(ascii(k) - 55 AS STRING) END), ''), ''), lambda k: CAST(TRY_CAST(k AS INT) AS BIGINT)), lambda a, k: (a * 10 + k) % 97) AS rest FROM y)
    SELECT item_id, raw, CASE WHEN NOT regexp_matches(c, '^[A-Z0-9]+$') THEN 'character' WHEN left(c, 2) NOT IN ({", ".join(repr(x) for x in V.IBAN_COUNTRIES)}) THEN 'country'
      WHEN CASE WHEN left(c, 2) = 'DE' THEN length(c) <> 22 ELSE NOT length(c) BETWEEN 15 AND 34 END THEN 'length' WHEN rest <> 1 THEN 'checksum' END AS problem FROM z""",
)
def val1(t: Tables):
    line = F.expr("""CASE s_suppkey % 6 WHEN 0 THEN 'DE89 3704 0044 0532 0130 00' WHEN 1 THEN 'DE88 3704 0044 0532 0130 00' WHEN 2 THEN 'OE45 1234 5678 9012' WHEN 3 THEN 'DE29@334550122257'
        WHEN 4 THEN 'GB82 WEST 1234 5698 7654 32' ELSE 'FR14 ' || CAST(s_suppkey AS STRING) || '0000' END || ' end'""")
    x = t.supplier.select(F.col("s_suppkey").alias("item_id"), F.explode(V.iban_candidates(line)).alias("raw"))
    return x.select("item_id", "raw", V.iban_problem(F.col("raw")).alias("problem"))


@query("val1_iban_documents", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{V.IBAN}')) AS INT) AS candidates FROM documents")
def val1_docs(t: Tables):
    return t.documents.select("doc_id", F.size(V.iban_candidates(F.col("text"))).alias("candidates"))


ICD_LINE = "'Diagnose ' || CASE p_partkey % 5 WHEN 0 THEN 'E10.9.' WHEN 1 THEN 'U07.1, A1212' WHEN 2 THEN '718.0 und ' || p_brand WHEN 3 THEN 'J45 744.09 E10.999' ELSE 'kein ' || p_type END"


@query(
    "val2_icd",
    rf"""WITH l AS (SELECT p_partkey AS item_id, regexp_replace({ICD_LINE}, '([^A-Za-z0-9.])', '\1\1', 'g') || '  ' AS s FROM part),
    a AS (SELECT item_id, regexp_extract_all(s, '(?:^|[^A-Za-z0-9])([A-Za-z][0-9]{{2}}(?:\.[0-9]{{1,2}})?)(?:[^A-Za-z0-9.]|\.[^0-9A-Za-z])', 1) AS codes, regexp_extract_all(s, '(?:^|[^A-Za-z0-9.])([0-9]{{3}}\.[0-9]{{1,2}})(?:[^A-Za-z0-9.]|\.[^0-9A-Za-z])', 1) AS bare FROM l)
    SELECT item_id, CAST(len(codes) + len(bare) AS INT) AS total, CAST(len(list_filter(codes, lambda x: upper(left(x, 1)) = 'U')) + len(bare) AS INT) AS invalid FROM a""",
)
def val2(t: Tables):
    c = V.icd_counts(F.expr(ICD_LINE))
    return t.part.select(F.col("p_partkey").alias("item_id"), c["total"].alias("total"), c["invalid"].alias("invalid"))


DATE_LINE = "'am ' || CAST(p_partkey % 35 AS STRING) || '.' || CASE WHEN p_partkey % 11 = 0 THEN '082' ELSE CAST(p_partkey % 14 AS STRING) END || '.' || CAST(1890 + p_partkey % 230 AS STRING) || ' bis heute'"


@query("val3_compact_dates", rf"""WITH d AS (SELECT p_partkey AS item_id, unnest(regexp_extract_all({DATE_LINE}, '\b([0-9]{{1,2}})[.\s]([0-9]{{1,3}})[.\s]([0-9]{{4}})\b')) AS m FROM part)
  SELECT item_id, m AS found, CAST(split_part(m, '.', 1) AS INT) BETWEEN 1 AND 31 AND length(split_part(m, '.', 2)) <= 2 AND CAST(split_part(m, '.', 2) AS INT) BETWEEN 1 AND 12 AND CAST(split_part(m, '.', 3) AS INT) BETWEEN 1900 AND 2099 AS plausible FROM d""")
def val3(t: Tables):
    d = t.part.select(F.col("p_partkey").alias("item_id"), F.explode(F.regexp_extract_all(F.expr(DATE_LINE), F.lit(V.DATE_COMPACT), F.lit(0))).alias("found"))
    part = [F.split_part("found", F.lit("."), F.lit(i)) for i in (1, 2, 3)]
    return d.select("item_id", "found", V.compact_date_ok(*part).alias("plausible"))


def claims_sql(text: str, table: str, key: str) -> str:
    """Dates by kind, each kind blanked before the next: CTEs k0 … k4 of (id, s, total, bad)."""
    parts = [f"k0 AS (SELECT {key} AS id, {text} AS s, 0 AS total, 0 AS bad FROM {table})"]
    for i, (pattern, fine) in enumerate(V.DATE_KINDS):
        found = f"regexp_extract_all(s, '{pattern}')"
        bad = f"len({found})" if fine is None else f"len(list_filter({found}, lambda x: NOT regexp_matches(x, '{fine}')))"
        parts.append(f"k{i + 1} AS (SELECT id, regexp_replace(s, '{pattern}', '|', 'g') AS s, total + len({found}) AS total, bad + {bad} AS bad FROM k{i})")
    return ", ".join(parts)


@query("val3_dates_claimed", f"WITH {claims_sql('text', 'documents', 'doc_id')} SELECT id AS doc_id, CAST(total AS INT) AS total, CAST(bad AS INT) AS implausible FROM k4")
def val3_all(t: Tables):
    return t.documents.select("doc_id", V.date_counts(F.col("text")).alias("d")).select("doc_id", "d.total", "d.implausible")


FORM = "p_partkey AS item_id, 'am ' || CAST(p_partkey % 35 AS STRING) || ' ' || CAST(p_partkey % 14 AS STRING) || ' 20 26 ' || p_brand || ' ' || CAST(p_size AS STRING) || ' 06/19/80, ' || CAST(p_partkey % 33 AS STRING) || '/' || CAST(p_size AS STRING) || '/1999; 3.' || CAST(p_partkey % 15 AS STRING) || '.' || CAST(1890 + p_size * 6 AS STRING) AS line"


@query("val3_torn_dates", f"WITH f AS (SELECT {FORM} FROM part), {claims_sql('line', 'f', 'item_id')} SELECT id AS item_id, CAST(total AS INT) AS total, CAST(bad AS INT) AS implausible FROM k4")
def val3_torn(t: Tables):
    f = t.part.selectExpr(*FORM.split(", ", 1))
    return f.select("item_id", V.date_counts(F.col("line")).alias("d")).select("item_id", "d.total", "d.implausible")


@query(
    "val4_orphan_labels",
    r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(replace(replace(text, '. ', ':' || chr(10)), ', ', ': '), chr(10)))) AS line FROM documents),
    p AS (SELECT doc_id, line, regexp_extract(line, '^([^:\n]{1,60}):', 1) AS head, trim(regexp_extract(line, '^[^:\n]{1,60}:\s*(.*)$', 1)) AS v FROM l WHERE line <> '' AND NOT starts_with(line, '|')),
    k AS (SELECT doc_id, v FROM p WHERE head <> '' AND regexp_matches(head, '\p{L}') AND NOT starts_with(v, '//'))
    SELECT doc_id, count(*) AS labelled, count(*) FILTER (v = '' OR regexp_matches(v, '^[_-]+$')) AS orphans FROM k GROUP BY doc_id""",
)
def val4(t: Tables):
    """Documents read as forms: sentences end as labels, and what follows their first comma is the value."""
    form = F.expr("replace(replace(text, '. ', ':\n'), ', ', ': ')")
    lines = t.documents.select("doc_id", F.explode(F.split(form, "\n")).alias("line")).withColumn("line", F.trim("line")).filter("line <> ''")
    label, orphan = V.label_of_line(F.col("line"))
    return lines.filter(label).groupBy("doc_id").agg(F.count("*").alias("labelled"), F.count_if(orphan).alias("orphans"))


@query(
    "val4_table_cells",
    """WITH r AS (SELECT p_partkey AS item_id, list_transform(string_split(CASE p_partkey % 4 WHEN 0 THEN ' Name: | ' || p_name || ' ' WHEN 1 THEN ' Name: | __ | Ort: ' WHEN 2 THEN ' 12: | x ' ELSE ' a | b: | - | c ' END, '|'), lambda x: trim(x)) AS c FROM part),
    e AS (SELECT item_id, unnest(c) AS k, unnest(list_append(c[2:], '')) AS v FROM r)
    SELECT item_id, CAST(count(*) FILTER (ends_with(k, ':') AND regexp_matches(k, '[A-Za-z]')) AS INT) AS labels, CAST(count(*) FILTER (ends_with(k, ':') AND regexp_matches(k, '[A-Za-z]') AND (v = '' OR regexp_matches(v, '^[_-]+$'))) AS INT) AS orphans FROM e GROUP BY item_id""",
)
def val4_cells(t: Tables):
    line = F.expr("CASE p_partkey % 4 WHEN 0 THEN '| Name: | ' || p_name || ' |' WHEN 1 THEN '| Name: | __ | Ort: |' WHEN 2 THEN '| 12: | x |' ELSE '| a | b: | - | c |' END")
    labels, orphans = V.label_cells(line)
    return t.part.select(F.col("p_partkey").alias("item_id"), labels.alias("labels"), orphans.alias("orphans"))


@query("val5_cancelled_before_booked", "SELECT l_orderkey * 10 + l_linenumber AS item_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 10")
def val5(t: Tables):
    """Rendered lines are searched for both labels; the first date of each counts."""
    day = "dd.MM.yyyy"
    text = F.concat(F.lit("Buchungsdatum: "), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 10), day), F.lit("\nStorno-Datum: "), F.date_format("l_shipdate", day))
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), text.alias("text"))
    booked = F.to_date(F.regexp_extract("text", r"(?i)Buchungsdatum\s*:?\s*(\d{1,2}\.\d{1,2}\.\d{4})", 1), "d.M.yyyy")
    gone = F.to_date(F.regexp_extract("text", r"(?i)Storno(?:datum|-Datum)?\s*:?\s*(\d{1,2}\.\d{1,2}\.\d{4})", 1), "d.M.yyyy")
    return rows.filter(gone < booked).select("item_id")
