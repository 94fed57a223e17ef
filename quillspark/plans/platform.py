"""Exports, deliveries, listings, mutations, names and folds that the other modules leave open."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import folds
from ..operators import visibility as V
from ..operators.joins import left_known
from .browse import VISIBLE
from .registry import Tables, query

# ------------------------------------------------------------------ sources, exports, deliveries


@query("src8_mail_ingest", "SELECT doc_id AS mail_id, sha256(text) AS sha, CAST(octet_length(encode(text)) AS BIGINT) AS size, CASE WHEN octet_length(encode(text)) > 4000 THEN 413 ELSE 202 END AS code FROM documents")
def src8(t: Tables):
    """Every mail gets a row: those above the cap a refusal."""
    size = F.octet_length("text").cast("long")
    return t.documents.select(F.col("doc_id").alias("mail_id"), F.sha2("text", 256).alias("sha"), size.alias("size"), F.when(size > 4000, 413).otherwise(202).alias("code"))


MAGIC = """files AS (SELECT p_partkey AS file_id, CASE p_partkey % 7 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' WHEN 4 THEN '.svg' WHEN 5 THEN '.txt' ELSE '.exe' END AS ext,
  CASE p_size % 5 WHEN 0 THEN '89504E47' WHEN 1 THEN 'FFD8FF00' WHEN 2 THEN '25504446' WHEN 3 THEN '504B0304' ELSE '00112233' END AS head FROM part)"""


@query("src11_attachment_kind", f"""WITH {MAGIC} SELECT file_id, CASE WHEN ext = '.png' THEN CASE WHEN head = '89504E47' THEN 'image' ELSE 'drop' END WHEN ext = '.jpg' THEN CASE WHEN head LIKE 'FFD8FF%' THEN 'image' ELSE 'drop' END
  WHEN ext = '.pdf' THEN CASE WHEN head = '25504446' THEN 'document' ELSE 'drop' END WHEN ext = '.docx' THEN CASE WHEN head = '504B0304' THEN 'document' ELSE 'drop' END WHEN ext IN ('.svg', '.txt') THEN 'attachment' ELSE 'drop' END AS kind FROM files""")
def src11(t: Tables):
    """Extension and first bytes have to agree; drawings and plain text go by extension alone."""
    k, z = F.col("p_partkey") % 7, F.col("p_size") % 5
    ext = F.element_at(F.array(*[F.lit(x) for x in (".png", ".jpg", ".pdf", ".docx", ".svg", ".txt", ".exe")]), (k + 1).cast("int"))
    content = F.unhex(F.element_at(F.array(*[F.lit(x + "AABB") for x in ("89504E47", "FFD8FF00", "25504446", "504B0304", "00112233")]), (z + 1).cast("int")))
    head = F.hex(F.substring(content, 1, 4))
    agrees = ((ext == ".png") & (head == "89504E47")) | ((ext == ".jpg") & head.startswith("FFD8FF"))
    paper = ((ext == ".pdf") & (head == "25504446")) | ((ext == ".docx") & (head == "504B0304"))
    kind = F.when(agrees, "image").when(paper, "document").when(ext.isin(".svg", ".txt"), "attachment").otherwise("drop")
    return t.part.select(F.col("p_partkey").alias("file_id"), kind.alias("kind"))


@query("snk3_job_export", "SELECT job_id, CAST(json_object('schema', 'job-export/1', 'job_id', job_id, 'filename', filename, 'status', status, 'pages', coalesce(page_count, 0), 'markdown', coalesce(markdown, '')) AS VARCHAR) AS export FROM jobs")
def snk3(t: Tables):
    row = F.struct(F.lit("job-export/1").alias("schema"), "job_id", "filename", "status", F.coalesce("page_count", F.lit(0)).alias("pages"), F.coalesce("markdown", F.lit("")).alias("markdown"))
    return t.jobs.select("job_id", F.to_json(row).alias("export"))


@query("snk4_mail_complete", "SELECT mail_id, bool_and(CASE WHEN outcome = 'job' THEN coalesce(j.status IN ('FINISHED', 'FAILED'), true) ELSE true END) AS complete FROM parts p LEFT JOIN jobs j ON j.job_id = p.job_id GROUP BY mail_id")
def snk4(t: Tables):
    p = left_known(t.parts.select("mail_id", "outcome", "job_id"), t.jobs.select("job_id", "status"), "job_id")
    done = F.when(F.col("outcome") == "job", F.coalesce(F.col("status").isin("FINISHED", "FAILED"), F.lit(True))).otherwise(True)
    return p.groupBy("mail_id").agg(F.bool_and(done).alias("complete"))


@query("snk5_benchmark_export", """SELECT run_id, CAST(json_object('run_id', run_id, 'variants', to_json(list({'job_id': job_id, 'status': status, 'grade': coalesce(grade, '-')} ORDER BY job_id))) AS VARCHAR) AS export FROM jobs WHERE run_id IS NOT NULL GROUP BY run_id""")
def snk5(t: Tables):
    v = F.sort_array(F.collect_list(F.struct("job_id", "status", F.coalesce("grade", F.lit("-")).alias("grade"))))
    return t.jobs.filter("run_id IS NOT NULL").groupBy("run_id").agg(v.alias("variants")).select("run_id", F.to_json(F.struct("run_id", "variants")).alias("export"))


@query("snk6_push_gate", "SELECT push_id, CASE WHEN j.status <> 'FINISHED' OR coalesce(j.markdown, '') = '' THEN 'not ready' WHEN j.grade = 'C' THEN 'blocked' ELSE 'push' END AS verdict FROM pushes p JOIN jobs j ON j.job_id = p.job_id")
def snk6(t: Tables):
    """A blocking grade stops a push; a missing one lets it pass."""
    j = t.jobs.select("job_id", "status", "markdown", "grade")
    verdict = F.when((F.col("j.status") != "FINISHED") | (F.coalesce("markdown", F.lit("")) == ""), "not ready").when(F.col("grade") == "C", "blocked").otherwise("push")
    return t.pushes.select("push_id", "job_id").join(j.alias("j"), "job_id").select("push_id", verdict.alias("verdict"))


SECRET = b"a secret of the connection"
INNER, OUTER = (bytes(x ^ pad for x in SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query("snk7_webhook_signature", f"""WITH p AS (SELECT delivery_id, CAST(json_object('event', event, 'delivery_id', delivery_id, 'owner_id', owner_id) AS VARCHAR) AS payload FROM deliveries)
  SELECT delivery_id, payload, 'sha256=' || sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(payload)))) AS signature FROM p""")
def snk7(t: Tables):
    d = t.deliveries.select("delivery_id", F.to_json(F.struct("event", "delivery_id", "owner_id")).alias("payload"))
    return d.withColumn("signature", N.hmac_sha256(F.col("payload"), SECRET))


CONNECTIONS = "connections AS (SELECT s_suppkey AS connection_id, s_suppkey % 40 AS owner_id, s_suppkey % 4 <> 0 AS enabled, CASE s_suppkey % 3 WHEN 0 THEN 'purchase,error' WHEN 1 THEN 'view' ELSE '' END AS events FROM supplier)"


@query("flt13_webhook_eligible", f"WITH {CONNECTIONS} SELECT delivery_id, coalesce(c.enabled AND list_contains(string_split(c.events, ','), d.event), false) AS eligible FROM deliveries d LEFT JOIN connections c ON c.connection_id = d.delivery_id % 97 AND c.owner_id = d.owner_id")
def flt13(t: Tables):
    """The configured connection exists, has the same owner, is enabled and lists the event."""
    s = F.col("s_suppkey")
    c = t.supplier.select(s.alias("connection_id"), (s % 40).alias("owner_id"), (s % 4 != 0).alias("enabled"), F.split(F.when(s % 3 == 0, "purchase,error").when(s % 3 == 1, "view").otherwise(""), ",").alias("events"))
    d = t.deliveries.withColumn("connection_id", F.col("delivery_id") % 97).join(c, ["connection_id", "owner_id"], "left")
    return d.select("delivery_id", F.coalesce(F.col("enabled") & F.array_contains("events", F.col("event")), F.lit(False)).alias("eligible"))


# ------------------------------------------------------------------ counts, orders, names


@query("agg8_filtered_chips", "SELECT CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'running' WHEN status = 'FINISHED' THEN 'completed' ELSE 'failed' END AS chip, count(*) AS n FROM jobs WHERE mode = 'single' AND (folder = 'F1' OR folder LIKE 'F1/%') AND run_id IS NULL GROUP BY 1")
def agg8(t: Tables):
    rows = V.browsable(t.jobs.filter("mode = 'single'")).filter(V.in_folder(F.col("folder"), "F1"))
    return rows.groupBy(V.status_chip(F.col("status")).alias("chip")).agg(F.count("*").alias("n"))


@query("agg10_processing_overview", "SELECT folder, count(*) FILTER (status IN ('PENDING', 'RUNNING')) AS running, count(*) FILTER (status = 'FINISHED') AS finished, count(*) FILTER (status = 'FAILED') AS failed, CAST(coalesce(sum(page_count) FILTER (status = 'FINISHED'), 0) AS BIGINT) AS pages FROM jobs GROUP BY folder")
def agg10(t: Tables):
    s = F.col("status")
    return t.jobs.groupBy("folder").agg(F.count_if(s.isin("PENDING", "RUNNING")).alias("running"), F.count_if(s == "FINISHED").alias("finished"), F.count_if(s == "FAILED").alias("failed"), F.coalesce(F.sum(F.when(s == "FINISHED", F.col("page_count"))), F.lit(0)).cast("long").alias("pages"))


@query("agg_rollup_folders", "SELECT folder, status, grouping(folder) + grouping(status) AS level, count(*) AS n FROM jobs GROUP BY ROLLUP (folder, status)")
def agg_rollup(t: Tables):
    return t.jobs.rollup("folder", "status").agg((F.grouping("folder").cast("long") + F.grouping("status").cast("long")).alias("level"), F.count("*").alias("n"))


@query("set_finished_but_not_pushed", "SELECT job_id FROM jobs WHERE status = 'FINISHED' EXCEPT SELECT job_id FROM pushes WHERE status = 'finished'")
def set_except(t: Tables):
    return t.jobs.filter("status = 'FINISHED'").select("job_id").subtract(t.pushes.filter("status = 'finished'").select("job_id"))


@query("ord11_stuck_running", "SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY profile_id ORDER BY idle_s, job_id) AS r FROM jobs WHERE status = 'RUNNING') WHERE r > 2")
def ord11(t: Tables):
    """Running jobs of a queue, the freshest first: as many as are active stay, the rest is requeued."""
    r = F.row_number().over(Window.partitionBy("profile_id").orderBy("idle_s", "job_id"))
    return t.jobs.filter("status = 'RUNNING'").withColumn("r", r).filter("r > 2").select("job_id")


@query("ord14_unique_usernames", """WITH w AS (SELECT c_custkey, 'user' || CAST(c_custkey // 40 AS VARCHAR) AS base, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS r FROM customer),
  k AS (SELECT *, list_reduce([r, 1, 3, 4], lambda a, x: CASE WHEN x <= a THEN a + 1 ELSE a END) AS n FROM w)
  SELECT c_custkey, CASE WHEN n = 1 THEN base ELSE base || CAST(n AS VARCHAR) END AS username FROM k""")
def ord14(t: Tables):
    """base, base2, …: the r-th newcomer gets the r-th name that is free, with base, base3 and base4 taken before."""
    rows = t.customer.select("c_custkey", F.expr("c_custkey div 40").alias("g"))
    taken = F.array(*[F.lit(x).cast("long") for x in (1, 3, 4)])
    r = F.row_number().over(Window.partitionBy("g").orderBy("c_custkey")).cast("long")
    rows = rows.withColumn("r", r).withColumn("n", F.aggregate(taken, F.col("r"), lambda a, x: F.when(x <= a, a + 1).otherwise(a)))
    base = F.concat(F.lit("user"), F.col("g").cast("string"))
    return rows.select("c_custkey", F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.col("n").cast("string"))).alias("username"))


@query("ver3_successors", """SELECT previous_id, count(*) AS n, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id) AS successors
  FROM (SELECT job_id, job_id - 1 - job_id % 3 AS previous_id FROM jobs WHERE job_id % 7 <> 0 AND job_id > 4) GROUP BY previous_id""")
def ver3_successors(t: Tables):
    j = F.col("job_id")
    links = t.jobs.filter("job_id % 7 <> 0 AND job_id > 4").select("job_id", (j - 1 - j % 3).alias("previous_id"))
    return links.groupBy("previous_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("job_id")), lambda x: x.cast("string")), ",").alias("successors"))


@query("ver7_chain_bypass", "SELECT job_id, CASE WHEN run_id IS NOT NULL OR mode = 'mail_attachment' THEN 1 ELSE count(*) FILTER (run_id IS NULL AND mode <> 'mail_attachment') OVER (PARTITION BY filename ORDER BY created_at, job_id) END AS version FROM jobs")
def ver7(t: Tables):
    """Children of benchmarks and mails are version 1 and no chain counts them."""
    w = Window.partitionBy("filename").orderBy("created_at", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    child = F.col("run_id").isNotNull() | (F.col("mode") == "mail_attachment")
    return t.jobs.select("job_id", F.when(child, F.lit(1).cast("long")).otherwise(F.count_if(~child).over(w)).alias("version"))


# ------------------------------------------------------------------ strings and boxes


@query("str5_header_rows", """SELECT p_partkey AS table_id, p_size % 5 = 0 OR (m1 IN ('', '[x]', '[ ]') AND m2 IN ('', '[x]', '[ ]')) AS is_header
  FROM (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN '[x]' WHEN 1 THEN '[ ]' WHEN 2 THEN '' ELSE p_brand END AS m1, CASE p_partkey % 3 WHEN 0 THEN '[x]' WHEN 1 THEN '' ELSE 'Ja' END AS m2 FROM part)""")
def str5(t: Tables):
    m1 = F.when(F.col("p_size") % 4 == 0, "[x]").when(F.col("p_size") % 4 == 1, " [ ] ").when(F.col("p_size") % 4 == 2, "").otherwise(F.col("p_brand"))
    m2 = F.when(F.col("p_partkey") % 3 == 0, "[x]").when(F.col("p_partkey") % 3 == 1, "").otherwise("Ja")
    rows = F.array(F.array(F.col("p_name"), F.lit("Ja"), F.lit("Nein")), F.array(F.lit("a"), m1, F.lit("")), F.array(F.lit("b"), F.lit(""), m2))
    return t.part.select(F.col("p_partkey").alias("table_id"), N.header_row(rows, F.col("p_size") % 5 == 0).alias("is_header"))


@query("str9_icd_rejoined", r"SELECT p_partkey AS item_id, regexp_replace('Diagnose ' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || ' ' || CAST(p_size % 10 AS VARCHAR) || '3 . ' || CAST(p_size % 8 AS VARCHAR) || ' seit', '\b([A-TV-Z])\s*([0-9])\s*([0-9])\s*[.]\s*([0-9]{1,2})\b', '\1\2\3.\4', 'g') AS line FROM part")
def str9(t: Tables):
    s = F.col("p_size")
    line = F.concat(F.lit("Diagnose "), F.char(65 + F.col("p_partkey") % 26), F.lit(" "), (s % 10).cast("string"), F.lit("3 . "), (s % 8).cast("string"), F.lit(" seit"))
    return t.part.select(F.col("p_partkey").alias("item_id"), N.rejoined_icd(line).alias("line"))


FRONT = """front AS (SELECT job_id, '---' || chr(10) || concat_ws(chr(10), 'source: "' || filename || '"', 'pages: ' || CAST(coalesce(page_count, structure_pages) AS VARCHAR), 'profile_id: ' || coalesce('"' || profile_id || '"', 'null'),
  CASE WHEN owner_id IS NOT NULL THEN 'uploaded_by: ' || CAST(owner_id AS VARCHAR) END, 'job_id: ' || CAST(job_id AS VARCHAR)) || chr(10) || '---' || chr(10) AS block, markdown FROM jobs)"""


def _front(t: Tables):
    pages = F.coalesce("page_count", "structure_pages")
    return t.jobs.select("job_id", "markdown", N.frontmatter([("source", F.col("filename"), False), ("pages", pages, False), ("profile_id", F.col("profile_id"), False), ("uploaded_by", F.col("owner_id"), True), ("job_id", F.col("job_id"), False)]).alias("block"))


@query("str10_frontmatter", f"WITH {FRONT} SELECT job_id, block FROM front")
def str10(t: Tables):
    return _front(t).select("job_id", "block")


@query("str11_prepended", f"WITH {FRONT} SELECT job_id, CASE WHEN coalesce(markdown, '') = '' THEN rtrim(block, chr(10)) ELSE rtrim(rtrim(block, chr(10)) || chr(10) || chr(10) || markdown, chr(10)) END AS text FROM front")
def str11(t: Tables):
    return _front(t).select("job_id", N.with_frontmatter(F.col("block"), F.col("markdown")).alias("text"))


@query("str12_added_keys", f"""WITH {FRONT} SELECT job_id, CASE WHEN job_id % 3 = 0 THEN coalesce(markdown, '') WHEN contains(block, chr(10) || 'uploaded_by:') THEN block || coalesce(markdown, '')
  ELSE left(block, length(block) - 4) || 'uploaded_by: "nobody"' || chr(10) || '---' || chr(10) || coalesce(markdown, '') END AS text FROM front""")
def str12(t: Tables):
    """A key is added only where the block lacks it, the body stays byte for byte, and a text without a block stays as it is."""
    body = F.coalesce("markdown", F.lit(""))
    text = F.when(F.col("job_id") % 3 == 0, body).otherwise(F.concat("block", body))
    return _front(t).select("job_id", N.with_key(text, "uploaded_by", F.lit("nobody")).alias("text"))


URLS = """urls AS (SELECT c_custkey AS item_id, CASE c_custkey % 7 WHEN 0 THEN 'https://Wiki.Example.org/base/' WHEN 1 THEN ' http://host:8090/x/y// ' WHEN 2 THEN 'ftp://host/x' WHEN 3 THEN 'https://u:p@host/x'
  WHEN 4 THEN 'https://host/x?q=1' WHEN 5 THEN 'https://host' ELSE 'http:///nohost' END AS url FROM customer)"""


@query("str19_base_urls", f"""WITH {URLS} SELECT item_id, CASE c WHEN 0 THEN 'https://Wiki.Example.org/base' WHEN 1 THEN 'http://host:8090/x/y' WHEN 5 THEN 'https://host' END AS base, CASE c WHEN 0 THEN 'wiki.example.org:443' WHEN 1 THEN 'host:8090' WHEN 5 THEN 'host:443' END AS host_key
  FROM (SELECT item_id, item_id % 7 AS c FROM urls)""")
def str19(t: Tables):
    k = F.col("c_custkey") % 7
    raw = ["https://Wiki.Example.org/base/", " http://host:8090/x/y// ", "ftp://host/x", "https://u:p@host/x", "https://host/x?q=1", "https://host", "http:///nohost"]
    base = N.base_url(F.element_at(F.array(*[F.lit(x) for x in raw]), (k + 1).cast("int")))
    return t.customer.select(F.col("c_custkey").alias("item_id"), base.alias("base"), N.host_key(base).alias("host_key"))


@query("str20_escaped_markdown", r"""SELECT p_partkey AS item_id, '![inline attachment: ' || replace(replace(replace(replace(p_name || ' (' || CAST(p_size AS VARCHAR) || ') #1]', '(', '\('), ')', '\)'), '#', '\#'), ']', '\]') || ']' AS placeholder FROM part""")
def str20(t: Tables):
    name = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(") #1]"))
    return t.part.select(F.col("p_partkey").alias("item_id"), N.cid_placeholder(name).alias("placeholder"))


@query("str21_content_disposition", """SELECT p_partkey AS item_id, 'attachment; filename="' || regexp_replace(n, '[^ -~]|["]', '_', 'g') || '"; filename*=UTF-8''''' || url_encode(n) AS header FROM (SELECT p_partkey, p_name || ' é"' || CAST(p_size AS VARCHAR) || '.md' AS n FROM part)""")
def str21(t: Tables):
    name = F.concat("p_name", F.lit(' é"'), F.col("p_size").cast("string"), F.lit(".md"))
    return t.part.select(F.col("p_partkey").alias("item_id"), N.content_disposition(name).alias("header"))


@query("str23_claims", r"""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '@x.org' WHEN 1 THEN 'no address' END AS email, CASE WHEN c_custkey % 3 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR) || '@y.org' END AS upn, 'DOM\' || c_name || '@z' AS unique_name,
    CASE WHEN c_custkey % 5 = 0 THEN c_name END AS preferred FROM customer), e AS (SELECT *, coalesce(CASE WHEN email LIKE '%@%' THEN email END, upn) AS address FROM c)
  SELECT c_custkey, address, coalesce(preferred, upn, split_part(address, '@', 1), CAST(c_custkey AS VARCHAR)) AS base FROM e""")
def str23(t: Tables):
    k, name = F.col("c_custkey"), F.col("c_name")
    claims = {
        "email": F.when(k % 4 == 0, F.concat(name, F.lit("@x.org"))).when(k % 4 == 1, "no address"), "upn": F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@y.org"))),
        "unique_name": F.concat(F.lit("DOM\\"), name, F.lit("@z")), "preferred_username": F.when(k % 5 == 0, name), "name": F.lit(None).cast("string"), "sub": k.cast("string"),
    }
    return t.customer.select("c_custkey", N.resolved_email(claims).alias("address"), N.username_base(claims).alias("base"))


@query("str25_part_names", "SELECT mail_id, part_index, coalesce(filename, 'part-' || CAST(part_index AS VARCHAR) || CASE outcome WHEN 'inline' THEN '.png' WHEN 'job' THEN '.pdf' ELSE '.bin' END) AS name, CASE WHEN part_index % 3 <> 0 THEN 'p' || CAST(part_index AS VARCHAR) || '@m' END AS cid FROM parts")
def str25(t: Tables):
    i = F.col("part_index").cast("string")
    ext = F.when(F.col("outcome") == "inline", ".png").when(F.col("outcome") == "job", ".pdf").otherwise(".bin")
    raw = F.when(F.col("part_index") % 3 != 0, F.concat(F.lit(" <p"), i, F.lit("@m> "))).otherwise(" <> ")
    return t.parts.select("mail_id", "part_index", F.coalesce("filename", F.concat(F.lit("part-"), i, ext)).alias("name"), N.content_id(raw).alias("cid"))


@query("rnd4_usable_boxes", "SELECT p_partkey AS block_id, CASE WHEN p_size % 3 = 0 THEN 'flat' WHEN p_partkey % 2 = 0 THEN 'polygon' ELSE 'none' END AS kind FROM part")
def rnd4(t: Tables):
    x = F.col("p_retailprice")
    box = F.when(F.col("p_size") % 3 == 0, F.array(x, x, x + 5, x + 9)).when(F.col("p_size") % 3 == 1, F.array(x, x))
    polygon = F.when(F.col("p_partkey") % 2 == 0, F.array(F.array(x, x), F.array(x, x + 1), F.array(x + 1, x))).otherwise(F.array(F.array(x, x), F.array(x, x)))
    return t.part.select(F.col("p_partkey").alias("block_id"), N.usable_box(box, polygon).alias("kind"))


LINES = "shapes AS (SELECT l_orderkey AS page, (l_partkey * 10000 + l_suppkey) * 10 + l_linenumber AS id, l_linenumber % 2 = 1 AS is_box, l_partkey % 50 * 4 AS x0, l_suppkey % 4 * 6 AS y0, l_suppkey % 4 * 6 + 8 + l_partkey % 5 AS y1 FROM lineitem)"


@query("jn10_checkbox_labels", f"""WITH {LINES}, near AS (SELECT b.page, b.id AS box_id, c.id AS label_id, row_number() OVER (PARTITION BY b.page, b.id ORDER BY c.x0 - b.x0 - 3, c.id) AS r FROM shapes b JOIN shapes c ON c.page = b.page AND NOT c.is_box AND c.x0 >= b.x0 + 3
    AND (least(b.y1, c.y1) - greatest(b.y0, c.y0)) * 10 >= 3 * least(b.y1 - b.y0, c.y1 - c.y0) WHERE b.is_box)
  SELECT s.page, s.id AS box_id, n.label_id, CASE WHEN s.x0 % 8 = 0 THEN '[x]' ELSE '[ ]' END AS mark FROM shapes s LEFT JOIN near n ON n.page = s.page AND n.box_id = s.id AND n.r = 1 WHERE s.is_box""")
def jn10(t: Tables):
    """Each box and the nearest text to its right on the same line of its page: an equi-join by page, then the least distance."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    shapes = t.lineitem.select(F.col("l_orderkey").alias("page"), ((p * 10000 + s) * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber"), (p % 50 * 4).alias("x0"), (s % 4 * 6).alias("y0"), (s % 4 * 6 + 8 + p % 5).alias("y1"))
    boxes = shapes.filter("l_linenumber % 2 = 1").withColumnRenamed("id", "box_id")
    text = shapes.filter("l_linenumber % 2 = 0").select("page", F.col("id").alias("label_id"), F.col("x0").alias("tx0"), F.col("y0").alias("ty0"), F.col("y1").alias("ty1"))
    overlap = (F.least("y1", "ty1") - F.greatest("y0", "ty0")) * 10 >= 3 * F.least(F.col("y1") - F.col("y0"), F.col("ty1") - F.col("ty0"))
    near = boxes.join(text, "page").filter((F.col("tx0") >= F.col("x0") + 3) & overlap)
    best = near.groupBy("page", "box_id").agg(F.min(F.struct((F.col("tx0") - F.col("x0")).alias("d"), "label_id"))["label_id"].alias("label_id"))
    mark = F.when(F.col("x0") % 8 == 0, "[x]").otherwise("[ ]")
    return boxes.join(best, ["page", "box_id"], "left").select("page", "box_id", "label_id", mark.alias("mark"))


# ------------------------------------------------------------------ listings


@query("lst3_recent_pushes", f"WITH {VISIBLE} SELECT push_id FROM pushes p JOIN jobs j ON j.job_id = p.job_id WHERE j.owner_id IN (SELECT owner_id FROM owners WHERE viewer_id = 7) ORDER BY p.created_at DESC, push_id DESC LIMIT 20")
def lst3(t: Tables):
    mine = V.visible(t.jobs.select("job_id", "owner_id"), t.users, 7).select("job_id")
    return t.pushes.join(mine, "job_id", "left_semi").orderBy(F.desc("created_at"), F.desc("push_id")).limit(20).select("push_id")


@query("lst5_run_jobs", "SELECT run_id, job_id, row_number() OVER (PARTITION BY run_id ORDER BY created_at, job_id) AS pos, CASE WHEN status = 'FAILED' THEN CAST(json_object('page_id', CAST(job_id AS VARCHAR), 'title', filename, 'error', coalesce(grade, 'unknown')) AS VARCHAR) END AS error FROM jobs WHERE run_id IS NOT NULL")
def lst5(t: Tables):
    pos = F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "job_id"))
    error = F.to_json(F.struct(F.col("job_id").cast("string").alias("page_id"), F.col("filename").alias("title"), F.coalesce("grade", F.lit("unknown")).alias("error")))
    return t.jobs.filter("run_id IS NOT NULL").select("run_id", "job_id", pos.cast("long").alias("pos"), F.when(F.col("status") == "FAILED", error).alias("error"))


@query("lst6_artifacts", "SELECT mail_id, part_index, row_number() OVER (PARTITION BY mail_id ORDER BY coalesce(filename, ''), part_index, size_bytes, outcome) AS pos, outcome = 'inline' OR coalesce(filename LIKE '%.pdf', false) AS shown_inline FROM parts WHERE outcome <> 'skipped' OR filename IS NOT NULL")
def lst6(t: Tables):
    kind = F.when(F.col("outcome") == "inline", "image/png").when(F.col("filename").endswith(".pdf"), "application/pdf").otherwise("text/html")
    pos = F.row_number().over(Window.partitionBy("mail_id").orderBy(F.coalesce("filename", F.lit("")), "part_index", "size_bytes", "outcome"))
    return t.parts.filter("outcome <> 'skipped' OR filename IS NOT NULL").select("mail_id", "part_index", pos.cast("long").alias("pos"), kind.isin(*N.INLINE_TYPES).alias("shown_inline"))


@query("lst7_collection_members", f"WITH {VISIBLE} SELECT job_id, CAST(body AS BIGINT) AS collection_id FROM jobs WHERE mode = 'collection' AND owner_id IN (SELECT owner_id FROM owners WHERE viewer_id = 7)")
def lst7(t: Tables):
    settings = F.concat(F.lit('{"collection_id": '), F.col("body").cast("string"), F.lit(', "x": [1]}'))
    rows = V.visible(t.jobs.filter("mode = 'collection'"), t.users, 7).withColumn("settings", settings)
    return rows.select("job_id", F.get_json_object("settings", "$.collection_id").cast("long").alias("collection_id")).filter("collection_id IS NOT NULL")


@query("lst10_dimensions", "SELECT 'team' AS kind, CAST(team_id AS VARCHAR) AS name, count(*) AS members FROM users WHERE team_id IS NOT NULL GROUP BY team_id UNION ALL SELECT 'provider', lower(r_name), CAST(r_regionkey AS BIGINT) FROM region WHERE r_regionkey % 2 = 0 ORDER BY 1, 2")
def lst10(t: Tables):
    teams = t.users.filter("team_id IS NOT NULL").groupBy("team_id").agg(F.count("*").alias("members"))
    on = t.region.filter("r_regionkey % 2 = 0").select(F.lit("provider").alias("kind"), F.lower("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("members"))
    return teams.select(F.lit("team").alias("kind"), F.col("team_id").cast("string").alias("name"), "members").unionByName(on).orderBy("kind", "name")


@query("lst11_part_lookup", "SELECT r.l_orderkey AS mail_id, r.l_linenumber AS part_index, CASE WHEN p.mail_id IS NULL THEN 404 ELSE 200 END AS code FROM lineitem r LEFT JOIN parts p ON p.mail_id = r.l_orderkey AND p.part_index = r.l_linenumber AND p.filename = 'part ' || CAST((r.l_partkey + r.l_suppkey % 2) % 50 AS VARCHAR) || '.pdf' AND p.outcome <> 'skipped'")
def lst11(t: Tables):
    """A part is found by mail and index only if the manifest's name agrees too and it was stored."""
    name = F.concat(F.lit("part "), ((F.col("l_partkey") + F.col("l_suppkey") % 2) % 50).cast("string"), F.lit(".pdf"))
    asked = t.lineitem.select(F.col("l_orderkey").alias("mail_id"), F.col("l_linenumber").alias("part_index"), name.alias("filename"))
    have = t.parts.filter("outcome <> 'skipped'").select("mail_id", "part_index", "filename", F.lit(200).alias("code"))
    return asked.join(have, ["mail_id", "part_index", "filename"], "left").select("mail_id", "part_index", F.coalesce("code", F.lit(404)).alias("code"))


@query("lst12_part_status", "SELECT mail_id, part_index, CASE WHEN outcome <> 'job' THEN outcome WHEN j.job_id IS NULL THEN 'deleted' ELSE lower(j.status) END AS live FROM parts p LEFT JOIN jobs j ON j.job_id = p.job_id")
def lst12(t: Tables):
    p = left_known(t.parts.select("mail_id", "part_index", "outcome", "job_id"), t.jobs.select("job_id", "status"), "job_id")
    return p.select("mail_id", "part_index", F.when(F.col("outcome") != "job", F.col("outcome")).when(F.col("status").isNull(), "deleted").otherwise(F.lower("status")).alias("live"))


# ------------------------------------------------------------------ fan-out, upserts, mutations


@query("fan2_collection_start", "SELECT job_id, 'small' AS profile_id, CASE WHEN body = 0 THEN NULL ELSE 'hook-' || CAST(body AS VARCHAR) END AS webhook FROM jobs WHERE mode = 'collection' AND status = 'PENDING'")
def fan2(t: Tables):
    """One profile and webhook for all members of a collection, given as a table of choices; old keys are cleared."""
    choice = t.jobs.filter("mode = 'collection'").select("body").distinct().select("body", F.lit("small").alias("profile_id"), F.when(F.col("body") != 0, F.concat(F.lit("hook-"), F.col("body").cast("string"))).alias("webhook"))
    return t.jobs.filter("mode = 'collection' AND status = 'PENDING'").select("job_id", "body").join(choice, "body").select("job_id", "profile_id", "webhook")


@query("ups3_frontier", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS page_id, CASE p_size % 4 WHEN 0 THEN 0 ELSE p_size END AS depth, CASE WHEN p_size % 4 >= 2 THEN p_brand ELSE '' END AS path, CASE WHEN p_size % 4 = 3 THEN CAST(p_partkey - 1 AS VARCHAR) END AS parent FROM part")
def ups3(t: Tables):
    """Entries of one to four elements, as older runs wrote them, in the shape of four."""
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    n = F.col("p_size") % 4
    entry = F.slice(F.array(k, z, F.col("p_brand"), (F.col("p_partkey") - 1).cast("string")), F.lit(1), (n + 1).cast("int"))
    return t.part.select("p_partkey", F.get(entry, F.lit(0)).alias("page_id"), F.coalesce(F.get(entry, F.lit(1)).cast("int"), F.lit(0)).alias("depth"), F.coalesce(F.get(entry, F.lit(2)), F.lit("")).alias("path"), F.get(entry, F.lit(3)).alias("parent"))


@query("mut2_retry_lower", "SELECT job_id, CASE profile_id WHEN 'medium_structured' THEN 'medium' WHEN 'medium' THEN 'small_structured' WHEN 'small_structured' THEN 'small' WHEN 'small' THEN 'tiny' END AS profile_id, CASE WHEN profile_id IN ('medium_structured', 'medium', 'small_structured', 'small') THEN 202 ELSE 409 END AS code FROM jobs WHERE status = 'FAILED'")
def mut2(t: Tables):
    from .browse import LOWER

    lower = F.element_at(F.create_map(*[F.lit(x) for pair in LOWER.items() for x in pair]), F.coalesce("profile_id", F.lit("")))
    return t.jobs.filter("status = 'FAILED'").select("job_id", lower.alias("profile_id"), F.when(lower.isNotNull(), 202).otherwise(409).alias("code"))


@query("mut6_delete_benchmark", "SELECT job_id FROM jobs WHERE run_id IS NULL OR run_id % 5 <> 0")
def mut6(t: Tables):
    """Runs that are deleted take all their children along."""
    gone = t.jobs.filter("run_id IS NOT NULL").select("run_id").distinct().filter("run_id % 5 = 0")
    return t.jobs.join(gone, "run_id", "left_anti").select("job_id")


RUNS = "runs AS (SELECT o_orderkey AS run_no, o_custkey % 400 AS source_id, o_orderstatus AS state, o_orderdate AS done_at, o_orderkey % 700 AS pages FROM orders)"


@query("mut7_refresh_start", f"""WITH {RUNS}, last AS (SELECT source_id, arg_max(pages, (done_at, run_no)) AS pages, max(run_no) AS any_run FROM runs WHERE state = 'F' GROUP BY source_id)
  SELECT s.source_id, least(l.pages, 200) AS pages FROM sources s JOIN last l USING (source_id) WHERE s.enabled AND s.source_id NOT IN (SELECT source_id FROM runs WHERE state = 'P' AND run_no % 30 = 0)""")
def mut7(t: Tables):
    """A due source repeats the scope of its last success, clamped anew, unless one of its runs is active."""
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 400).alias("source_id"), "o_orderstatus", "o_orderdate", (F.col("o_orderkey") % 700).alias("pages"))
    last = o.filter("o_orderstatus = 'F'").groupBy("source_id").agg(F.max(F.struct("o_orderdate", "o_orderkey", "pages"))["pages"].alias("pages"))
    active = o.filter("o_orderstatus = 'P' AND o_orderkey % 30 = 0").select("source_id").distinct()
    return t.sources.filter("enabled").select("source_id").join(last, "source_id").join(active, "source_id", "left_anti").select("source_id", F.least("pages", F.lit(200)).alias("pages"))


@query("mut8_refresh_outcome", f"""WITH {RUNS} SELECT run_no, CASE WHEN state = 'F' THEN done_at END AS refreshed_at, CASE state WHEN 'F' THEN '' WHEN 'O' THEN 'run ' || CAST(run_no AS VARCHAR) || ' failed' ELSE 'as before' END AS error FROM runs""")
def mut8(t: Tables):
    """Success sets the time and clears the error, failure sets the error alone, cancelling changes neither."""
    s = F.col("o_orderstatus")
    error = F.when(s == "F", "").when(s == "O", F.concat(F.lit("run "), F.col("o_orderkey").cast("string"), F.lit(" failed"))).otherwise("as before")
    return t.orders.select(F.col("o_orderkey").alias("run_no"), F.when(s == "F", F.col("o_orderdate")).alias("refreshed_at"), error.alias("error"))


# ------------------------------------------------------------------ folds


def _events(t: Tables):
    """Micros of a clock that runs 1,000 times as fast, so that gaps fit the rules."""
    return t.events.select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("tick"), (F.col("event_type") != "signup").alias("failed"))


CLOCK = "ev AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS tick, event_type <> 'signup' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events)"


@query("mut10_cooldown", f"""WITH RECURSIVE {CLOCK}, go AS (SELECT user_id, event_id, tick, r, true AS accepted, tick AS held FROM ev WHERE r = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.tick, e.r, e.tick - g.held >= 600000000, CASE WHEN e.tick - g.held >= 600000000 THEN e.tick ELSE g.held END FROM go g JOIN ev e ON e.user_id = g.user_id AND e.r = g.r + 1)
  SELECT user_id, tick, event_id, accepted FROM go""")
def mut10(t: Tables):
    return folds.fold(_events(t), "user_id", folds.Cooldown(600))


@query("st7_session_touch", f"""WITH RECURSIVE {CLOCK}, go AS (SELECT user_id, event_id, tick, r, tick AS began, tick AS touched_at, least(tick + 1200000000, tick + 3600000000) AS expires, true AS touched FROM ev WHERE r = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.tick, e.r, CASE WHEN e.tick >= g.expires THEN e.tick ELSE g.began END, CASE WHEN e.tick >= g.expires OR e.tick - g.touched_at > 300000000 THEN e.tick ELSE g.touched_at END,
      CASE WHEN e.tick >= g.expires THEN e.tick + 1200000000 WHEN e.tick - g.touched_at > 300000000 THEN least(e.tick + 1200000000, g.began + 3600000000) ELSE g.expires END, e.tick >= g.expires OR e.tick - g.touched_at > 300000000
    FROM go g JOIN ev e ON e.user_id = g.user_id AND e.r = g.r + 1)
  SELECT user_id, tick, event_id, began, touched, expires FROM go""")
def st7(t: Tables):
    return folds.fold(_events(t), "user_id", folds.SessionTouch(300, 1200, 3600))


@query("st6_lockout", f"""WITH RECURSIVE {CLOCK}, go AS (SELECT user_id, event_id, tick, r, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN failed THEN 1 ELSE 0 END AS n, CASE WHEN failed THEN tick END AS last, CAST(NULL AS BIGINT) AS until FROM ev WHERE r = 1 UNION ALL
    SELECT user_id, event_id, tick, r, CASE WHEN locked THEN 'refused' WHEN NOT failed THEN 'ok' WHEN k >= 4 THEN 'locked' ELSE 'failed' END, CASE WHEN locked THEN n WHEN NOT failed OR k >= 4 THEN 0 ELSE k END,
      CASE WHEN locked THEN last WHEN failed THEN tick END, CASE WHEN locked THEN until WHEN failed AND k >= 4 THEN tick + 900000000 END
    FROM (SELECT e.user_id, e.event_id, e.tick, e.r, e.failed, g.n, g.last, g.until, coalesce(e.tick < g.until, false) AS locked, CASE WHEN g.last IS NULL OR e.tick - g.last > 2700000000 THEN 1 ELSE g.n + 1 END AS k FROM go g JOIN ev e ON e.user_id = g.user_id AND e.r = g.r + 1))
  SELECT user_id, tick, event_id, outcome, CAST(n AS BIGINT) AS count FROM go""")
def st6(t: Tables):
    """Failures add up while at most a window apart, the last allowed one locks, a success clears, a locked account refuses."""
    return folds.fold(_events(t), "user_id", folds.Lockout(4, 2700, 900), flag="failed")


# ------------------------------------------------------------------ parses


@query("prs4_attachment_meta", """SELECT p_partkey AS item_id, 'a' || CAST(p_partkey AS VARCHAR) AS att_id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'attachment' END AS name, CASE WHEN p_size % 3 = 0 THEN '/dl/' ELSE '/old/' END || CAST(p_partkey AS VARCHAR) AS link FROM part WHERE p_size % 7 <> 0 AND p_partkey % 9 <> 0""")
def prs4(t: Tables):
    """Metadata in either API's shape; entries without id or link are dropped."""
    k = F.col("p_partkey").cast("string")
    row = F.struct(
        F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("a"), k)).alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("title"),
        F.when((F.col("p_partkey") % 9 != 0) & (F.col("p_size") % 3 == 0), F.concat(F.lit("/dl/"), k)).alias("downloadLink"),
        F.when((F.col("p_partkey") % 9 != 0) & (F.col("p_size") % 3 != 0), F.struct(F.concat(F.lit("/old/"), k).alias("download"))).alias("_links"),
    )
    j = t.part.select(F.col("p_partkey").alias("item_id"), F.to_json(row).alias("j"))
    out = j.select("item_id", F.get_json_object("j", "$.id").alias("att_id"), F.coalesce(F.get_json_object("j", "$.title"), F.lit("attachment")).alias("name"), F.coalesce(F.get_json_object("j", "$.downloadLink"), F.get_json_object("j", "$._links.download")).alias("link"))
    return out.filter("att_id IS NOT NULL AND link IS NOT NULL")
