"""Versions, state machines, queues, listings, upserts, mutations, sinks and parses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import versioning as R
from ..operators import visibility as V
from ..operators.crawl import budgeted_crawl
from ..operators.joins import left_known
from ..operators.temporal import as_of
from .browse import VISIBLE
from .registry import Tables, query

# ------------------------------------------------------------------ versions


@query("ver1_content_hash", "SELECT doc_id, sha256(text) AS sha, doc_id % 2 = 0 AS even FROM documents")
def ver1(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), (F.col("doc_id") % 2 == 0).alias("even"))


@query(
    "ver2_upload_replay",
    """WITH l AS (SELECT filename, job_id, created_at, body, lag(body) OVER w AS before FROM jobs WINDOW w AS (PARTITION BY filename ORDER BY created_at, job_id))
    SELECT job_id, coalesce(body = before, false) AS duplicate, CAST(sum(CASE WHEN coalesce(body = before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY filename ORDER BY created_at, job_id) AS BIGINT) AS version FROM l""",
)
def ver2(t: Tables):
    return R.replay_uploads(t.jobs, "filename", ["created_at", "job_id"], "body").select("job_id", "duplicate", "version")


CHAIN = "links AS (SELECT job_id, CASE WHEN job_id % 7 <> 0 AND job_id > 4 THEN job_id - 1 - job_id % 3 END AS previous_id FROM jobs)"


@query(
    "ver3_chain_roots",
    f"""WITH RECURSIVE {CHAIN}, up AS (SELECT job_id, job_id AS at_id, CAST(0 AS BIGINT) AS depth FROM links UNION ALL
      SELECT u.job_id, l.previous_id, u.depth + 1 FROM up u JOIN links l ON l.job_id = u.at_id JOIN links p ON p.job_id = l.previous_id)
    SELECT job_id, arg_max(at_id, depth) AS root, max(depth) AS depth FROM up GROUP BY job_id""",
)
def ver3(t: Tables):
    j = F.col("job_id")
    return R.chain_roots(t.jobs.select("job_id", F.when((j % 7 != 0) & (j > 4), j - 1 - j % 3).alias("previous_id")))


@query(
    "ver3_fork_tree",
    f"""WITH RECURSIVE {CHAIN}, walk AS (SELECT job_id, [job_id] AS path FROM links WHERE previous_id IS NULL OR previous_id NOT IN (SELECT job_id FROM links)
      UNION ALL SELECT l.job_id, list_append(w.path, l.job_id) FROM walk w JOIN links l ON l.previous_id = w.job_id),
    sizes AS (SELECT job_id, count(*) AS size FROM (SELECT unnest(path) AS job_id FROM walk) GROUP BY job_id)
    SELECT w.job_id, path[1] AS root, CAST(len(path) - 1 AS BIGINT) AS depth, row_number() OVER (PARTITION BY path[1] ORDER BY path) - 1 AS place, size FROM walk w JOIN sizes s ON s.job_id = w.job_id""",
)
def ver3_tree(t: Tables):
    """Every version's place in its forked chain: generation, position in preorder, number of descendants and itself."""
    j = F.col("job_id")
    return R.chain_tree(t.jobs.select("job_id", F.when((j % 7 != 0) & (j > 4), j - 1 - j % 3).alias("previous_id")))


@query("ver4_mail_replay", "SELECT mail_id, first_value(mail_id) OVER (PARTITION BY owner, body ORDER BY mail_id DESC) AS replay_of FROM (SELECT job_id AS mail_id, owner_id AS owner, body FROM jobs WHERE mode = 'mail_attachment' AND owner_id IS NOT NULL)")
def ver4(t: Tables):
    m = t.jobs.filter("mode = 'mail_attachment' AND owner_id IS NOT NULL")
    return m.select(F.col("job_id").alias("mail_id"), F.max("job_id").over(Window.partitionBy("owner_id", "body")).alias("replay_of"))


@query("ver5_latest_edit", "SELECT name_no, arg_max(job_id, body * 1000000000 + job_id) AS latest FROM jobs GROUP BY name_no")
def ver5(t: Tables):
    return t.jobs.groupBy("name_no").agg(F.max(F.struct("body", "job_id"))["job_id"].alias("latest"))


@query("ver6_content_stale", "SELECT push_id, CAST(j.body AS STRING) <> pushed_body AS stale FROM pushes p JOIN jobs j ON j.job_id = p.job_id")
def ver6(t: Tables):
    return t.pushes.join(t.jobs, "job_id").select("push_id", (F.col("body").cast("string") != F.col("pushed_body")).alias("stale"))


@query(
    "ver6_edit_at_push",
    """WITH e AS (SELECT l_orderkey AS job_id, l_linenumber AS version, l_shipdate - INTERVAL 20 DAY + l_linenumber * INTERVAL 1 SECOND AS edited_at, l_partkey % 4 AS body FROM lineitem WHERE l_linenumber % 2 = 1),
    p AS (SELECT push_id, job_id, created_at, pushed_body FROM pushes)
    SELECT push_id, e.version, sha256(CAST(e.body AS VARCHAR)) <> sha256(pushed_body) AS stale FROM p ASOF LEFT JOIN e ON p.job_id = e.job_id AND p.created_at >= e.edited_at""",
)
def ver6_at_push(t: Tables):
    """The edit that was current when a job was pushed, and whether the pushed content differs from it."""
    edits = t.lineitem.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("version"), F.expr("l_shipdate - INTERVAL 20 DAY + make_interval(0, 0, 0, 0, 0, 0, l_linenumber)").alias("edited_at"), (F.col("l_partkey") % 4).alias("body"))
    out = as_of(t.pushes.select("push_id", "job_id", "created_at", "pushed_body"), edits, ["job_id"], "created_at", "edited_at", "version")
    return out.select("push_id", F.col("found.version").alias("version"), (F.sha2(F.col("found.body").cast("string"), 256) != F.sha2("pushed_body", 256)).alias("stale"))


# ------------------------------------------------------------------ state and queues


@query("st1_rate_limit_aligned", "SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS opened, count(*) AS hits, count(*) > 3 AS limited FROM events GROUP BY 1, 2")
def st1(t: Tables):
    g = t.events.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("opened")).agg(F.count("*").alias("hits"))
    return g.withColumn("limited", F.col("hits") > 3)


@query("st2_claims", "SELECT job_id, CASE WHEN status = 'PENDING' THEN 'claimed' WHEN status = 'RUNNING' AND idle_s > 120 THEN 'reclaimed' ELSE 'skipped' END AS verdict FROM jobs")
def st2(t: Tables):
    return t.jobs.select("job_id", R.claim(F.col("status"), F.col("idle_s")).alias("verdict"))


@query(
    "st3_page_state_diff",
    """WITH pg AS (SELECT page_id, page_id % 4 AS version FROM pages), st AS (SELECT page_id, page_id % 3 AS version, page_id * 4 + 1 AS job_id FROM pages WHERE page_id % 5 <> 0)
    SELECT pg.page_id, CASE WHEN st.version IS NULL THEN 'new' WHEN j.job_id IS NULL THEN 'restarted' WHEN st.version = pg.version THEN 'unchanged' ELSE 'changed' END AS verdict
    FROM pg LEFT JOIN st USING (page_id) LEFT JOIN (SELECT job_id FROM jobs WHERE status <> 'FAILED') j ON j.job_id = st.job_id""",
)
def st3(t: Tables):
    p = t.pages.select("page_id", (F.col("page_id") % 4).alias("version"))
    s = t.pages.filter("page_id % 5 <> 0").select("page_id", (F.col("page_id") % 3).alias("version"), (F.col("page_id") * 4 + 1).alias("job_id"))
    return R.page_diff(p, s, t.jobs.filter("status <> 'FAILED'").select("job_id")).select("page_id", "verdict")


@query(
    "st4_bounded_crawl",
    """WITH RECURSIVE kids AS (SELECT p_partkey AS parent, unnest([p_partkey * 3 + 1, p_partkey * 3 + 2, p_partkey * 2 + 1]) AS child FROM part),
    bfs AS (SELECT 1::BIGINT AS page, 0 AS depth UNION SELECT child, depth + 1 FROM bfs JOIN kids ON parent = page WHERE depth < 10)
    SELECT page, min(depth) AS depth FROM bfs GROUP BY page ORDER BY min(depth), page LIMIT 200""",
)
def st4(t: Tables):
    p = F.col("p_partkey")
    kids = t.part.select(p.alias("parent"), F.explode(F.array(p * 3 + 1, p * 3 + 2, p * 2 + 1)).alias("page"))
    return R.bounded_crawl(kids, t.spark.createDataFrame([(1,)], "page long"))


@query(
    "st4_crawl_budgets",
    """WITH RECURSIVE kids AS (SELECT p_partkey AS parent, unnest([p_partkey * 3 + 1, p_partkey * 3 + 2, p_partkey * 2 + 1]) AS page, unnest([0, 1, 2]) AS position FROM part),
    adj AS (SELECT parent, list(page ORDER BY position) AS pages FROM kids GROUP BY parent), facts AS (SELECT p_partkey AS page, p_name AS title, p_size * 1000 AS size FROM part),
    st AS (SELECT 1 AS i, [1::BIGINT] AS q, [0] AS depths, [NULL::BIGINT] AS parents, [['Top']] AS paths, 0::BIGINT AS total, true AS open
      UNION ALL SELECT i + 1, list_concat(q, new), list_concat(depths, list_transform(new, lambda x: depths[i] + 1)), list_concat(parents, list_transform(new, lambda x: q[i])), list_concat(paths, list_transform(new, lambda x: list_append(paths[i], title))), total + size, true
      FROM (SELECT st.*, coalesce(f.size, 0) AS size, coalesce(f.title, '') AS title, CASE WHEN depths[i] < 5 THEN list_slice(list_filter(coalesce(a.pages, []), lambda x: NOT list_contains(q, x)), 1, 150 - len(q)) ELSE [] END AS new
        FROM st LEFT JOIN facts f ON f.page = st.q[st.i] LEFT JOIN adj a ON a.parent = st.q[st.i] WHERE st.i <= len(st.q)) WHERE total + size <= 2000000),
    fin AS (SELECT * FROM st ORDER BY i DESC LIMIT 1), n AS (SELECT unnest(range(1, len(q) + 1)) AS k, * FROM fin)
    SELECT q[k] AS page, k - 1 AS place, depths[k] AS depth, parents[k] AS parent, array_to_string(paths[k], ' > ') AS path, (k - 1) // 25 AS chunk, k < i AS imported FROM n""",
)
def st4_budgets(t: Tables):
    """The crawl's queue with its budgets: depth 5, 150 pages, 2 MB; order, paths and chunks as the queue gives them."""
    p = F.col("p_partkey")
    kids = t.part.select(p.alias("parent"), F.posexplode(F.array(p * 3 + 1, p * 3 + 2, p * 2 + 1)).alias("position", "page"))
    facts = t.part.select(p.alias("page"), F.col("p_name").alias("title"), (F.col("p_size") * 1000).alias("size"))
    start = t.spark.createDataFrame([(1, ["Top"])], "page long, path array<string>")
    out = budgeted_crawl(kids, facts, start, most_depth=5, most_pages=150, most_bytes=2_000_000)
    return out.withColumn("path", F.array_join("path", " > "))


@query("st5_retries", """SELECT delivery_id, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'delivered' WHEN (http_status = 0 OR http_status >= 500) AND attempts < 5 THEN 'retry' ELSE 'failed' END AS verdict,
  CASE greatest(attempts - 1, 0) WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 120 ELSE 240 END::BIGINT AS wait_s FROM deliveries""")
def st5(t: Tables):
    return t.deliveries.select("delivery_id", R.retry_decision(F.col("http_status"), F.col("attempts")).alias("verdict"), R.backoff_seconds(F.col("attempts")).alias("wait_s"))


@query(
    "st6_lockout_streaks",
    """WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS breaks FROM events WHERE event_type IN ('error', 'signup')),
    f AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, breaks ORDER BY ts, event_id) AS gap FROM e WHERE bad),
    g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL '10 days' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, breaks ORDER BY ts, event_id) AS streak FROM f)
    SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM g GROUP BY user_id, breaks, streak""",
)
def st6(t: Tables):
    e = t.events.filter("event_type IN ('error', 'signup')")
    return R.failure_streaks(e, "user_id", "ts", F.col("event_type") == "error", gap_s=864_000).select("user_id", "n", "first", "last")


@query("st9_redelivery", "SELECT job_id, CASE WHEN profile_id IN ('medium', 'medium_structured') THEN 'fail' ELSE 'run' END AS verdict, CASE profile_id WHEN 'medium' THEN 'small_structured' WHEN 'medium_structured' THEN 'medium' END AS suggested FROM jobs WHERE status = 'RUNNING'")
def st9(t: Tables):
    p = F.col("profile_id")
    heavy = p.isin("medium", "medium_structured")
    return t.jobs.filter("status = 'RUNNING'").select("job_id", F.when(heavy, "fail").otherwise("run").alias("verdict"), F.when(p == "medium", "small_structured").when(p == "medium_structured", "medium").alias("suggested"))


@query("st10_startup_recovery", "SELECT job_id, CASE WHEN status = 'RUNNING' THEN 'PENDING' ELSE status END AS status FROM jobs")
def st10(t: Tables):
    return t.jobs.select("job_id", F.when(F.col("status") == "RUNNING", "PENDING").otherwise(F.col("status")).alias("status"))


@query("st11_stranded", "SELECT job_id FROM jobs WHERE status = 'PENDING' AND idle_s > 180")
def st11(t: Tables):
    return t.jobs.filter("status = 'PENDING' AND idle_s > 180").select("job_id")


@query("st14_cancel", "SELECT job_id, CASE WHEN status = 'PENDING' THEN 'cancelled' WHEN status = 'RUNNING' AND idle_s > 600 THEN 'forced' WHEN status = 'RUNNING' THEN 'flagged' ELSE 'refused' END AS outcome FROM jobs WHERE mode = 'import'")
def st14(t: Tables):
    s = F.col("status")
    o = F.when(s == "PENDING", "cancelled").when((s == "RUNNING") & (F.col("idle_s") > 600), "forced").when(s == "RUNNING", "flagged").otherwise("refused")
    return t.jobs.filter("mode = 'import'").select("job_id", o.alias("outcome"))


# ------------------------------------------------------------------ listings, upserts, mutations


@query("lst1_lookup", """SELECT r.event_id, CASE WHEN j.job_id IS NOT NULL AND (u.role = 'admin' OR j.owner_id = u.user_id OR o.team_id = u.team_id) THEN 200 ELSE 404 END AS code,
    CASE WHEN u.role = 'admin' OR j.owner_id = u.user_id OR o.team_id = u.team_id THEN j.filename END AS filename
  FROM events r LEFT JOIN jobs j ON j.job_id = r.event_id LEFT JOIN users u ON u.user_id = r.user_id LEFT JOIN users o ON o.user_id = j.owner_id""")
def lst1(t: Tables):
    """Point lookups in bulk, one a request: an admin sees all, others their own and their team's; the rest is not found."""
    viewer = t.users.select("user_id", "role", "team_id")
    owner = t.users.select(F.col("user_id").alias("owner_id"), F.col("team_id").alias("owner_team"))
    jobs = left_known(t.jobs.select(F.col("job_id").alias("event_id"), "owner_id", "filename"), owner, "owner_id")
    r = t.events.select("event_id", "user_id").join(jobs, "event_id", "left").join(viewer, "user_id", "left")
    seen = F.coalesce((F.col("role") == "admin") | (F.col("owner_id") == F.col("user_id")) | (F.col("owner_team") == F.col("team_id")), F.lit(False))
    return r.select("event_id", F.when(seen & F.col("filename").isNotNull(), 200).otherwise(404).alias("code"), F.when(seen, F.col("filename")).alias("filename"))


@query("lst2_own_deliveries", "SELECT delivery_id FROM deliveries WHERE owner_id = 12 ORDER BY delivery_id DESC LIMIT 20")
def lst2(t: Tables):
    return t.deliveries.filter("owner_id = 12").orderBy(F.desc("delivery_id")).limit(20).select("delivery_id")


@query("lst4_runs_with_total", f"WITH {VISIBLE} SELECT run_id, count(*) AS jobs, max(created_at) AS latest FROM jobs WHERE run_id IS NOT NULL AND owner_id IN (SELECT owner_id FROM owners WHERE viewer_id = 9) GROUP BY run_id")
def lst4(t: Tables):
    return V.visible(t.jobs.filter("run_id IS NOT NULL"), t.users, 9).groupBy("run_id").agg(F.count("*").alias("jobs"), F.max("created_at").alias("latest"))


@query("lst8_markdown_source", "SELECT job_id, CASE WHEN coalesce(markdown, '') <> '' THEN 'column' WHEN body > 2 THEN 'edited' ELSE 'file' END AS source FROM jobs WHERE status = 'FINISHED'")
def lst8(t: Tables):
    s = F.when(F.coalesce("markdown", F.lit("")) != "", "column").when(F.col("body") > 2, "edited").otherwise("file")
    return t.jobs.filter("status = 'FINISHED'").select("job_id", s.alias("source"))


@query("lst9_capabilities", "SELECT 0 AS kind, CAST(r_regionkey AS VARCHAR) AS ord, r_name AS name FROM region UNION ALL SELECT 1, username, username FROM users WHERE is_active ORDER BY 1, 2")
def lst9(t: Tables):
    fixed = t.region.select(F.lit(0).alias("kind"), F.col("r_regionkey").cast("string").alias("ord"), F.col("r_name").alias("name"))
    on = t.users.filter("is_active").select(F.lit(1).alias("kind"), F.col("username").alias("ord"), F.col("username").alias("name"))
    return fixed.unionByName(on).orderBy("kind", "ord")


@query("fan1_variants", "SELECT o.o_custkey AS item_id, v.pos, v.name FROM (SELECT DISTINCT o_custkey FROM orders) o, (VALUES (0, 'c1'), (1, 'c2'), (2, 'tiny')) v(pos, name)")
def fan1(t: Tables):
    names = F.array(*[F.lit(x) for x in ("c1", "c2", "tiny")])
    return t.orders.select(F.col("o_custkey").alias("item_id")).distinct().select("item_id", F.posexplode(names).alias("pos", "name"))


@query("ups1_new_tags", "SELECT DISTINCT lower(trim(p_brand)) AS name FROM part WHERE lower(trim(p_brand)) NOT IN (SELECT name FROM tags)")
def ups1(t: Tables):
    return t.part.select(F.lower(F.trim("p_brand")).alias("name")).distinct().join(t.tags, "name", "left_anti").select("name")


@query("ups2_page_tags", "SELECT p_partkey AS page_id, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END || CASE WHEN p_brand = 'x' OR p_type = 'x' THEN '' ELSE '|x' END AS tags FROM part")
def ups2(t: Tables):
    u = F.array_union(F.array("p_brand", "p_type"), F.array("p_type", F.lit("x")))
    return t.part.select(F.col("p_partkey").alias("page_id"), F.array_join(u, "|").alias("tags"))


@query("ups4_bounded_errors", "SELECT worker, event_id, CASE WHEN length(message) > 9 THEN left(message, 6) || '...' ELSE message END AS message FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY event_id) AS r FROM logs WHERE level = 'ERROR') WHERE r <= 200")
def ups4(t: Tables):
    from ..functions.paths import truncated

    r = F.row_number().over(Window.partitionBy("worker").orderBy("event_id"))
    return t.logs.filter("level = 'ERROR'").withColumn("r", r).filter("r <= 200").select("worker", "event_id", truncated(F.col("message"), 9).alias("message"))


@query("mut1_restart", f"""WITH {VISIBLE} SELECT job_id, CASE WHEN o.owner_id IS NULL OR run_id IS NOT NULL THEN 404 WHEN mode = 'import' OR (status = 'RUNNING' AND idle_s < 600) THEN 409 WHEN profile_id IS NULL THEN 422 ELSE 202 END AS code
  FROM jobs j LEFT JOIN (SELECT owner_id FROM owners WHERE viewer_id = 7) o ON o.owner_id = j.owner_id""")
def mut1(t: Tables):
    mine = V.allowed_owners(t.users).filter("viewer_id = 7").select("owner_id", F.lit(True).alias("seen"))
    code = (
        F.when(F.col("seen").isNull() | F.col("run_id").isNotNull(), 404)
        .when((F.col("mode") == "import") | ((F.col("status") == "RUNNING") & (F.col("idle_s") < 600)), 409)
        .when(F.col("profile_id").isNull(), 422).otherwise(202)
    )
    return left_known(t.jobs, mine, "owner_id").select("job_id", code.alias("code"))


@query("mut3_folder_restart", "SELECT folder, count(*) FILTER (mode = 'import') AS skipped_import, count(*) FILTER (mode <> 'import' AND status IN ('PENDING', 'RUNNING')) AS skipped_active, count(*) FILTER (mode <> 'import' AND status NOT IN ('PENDING', 'RUNNING')) AS restarted FROM jobs GROUP BY folder")
def mut3(t: Tables):
    imp, act = F.col("mode") == "import", F.col("status").isin("PENDING", "RUNNING")
    return t.jobs.groupBy("folder").agg(F.count_if(imp).alias("skipped_import"), F.count_if(~imp & act).alias("skipped_active"), F.count_if(~imp & ~act).alias("restarted"))


@query("mut4_delete_folder", f"WITH {VISIBLE} SELECT job_id FROM jobs WHERE NOT (folder = 'F2' AND coalesce(owner_id IN (SELECT owner_id FROM owners WHERE viewer_id = 8), false))")
def mut4(t: Tables):
    gone = V.visible(t.jobs.filter("folder = 'F2'"), t.users, 8).select("job_id")
    return t.jobs.join(gone, "job_id", "left_anti").select("job_id")


@query("mut5_delete_mail_keep_jobs", "SELECT mail_id, part_index, CASE WHEN mail_id % 10 = 0 THEN NULL ELSE outcome END AS outcome FROM parts")
def mut5(t: Tables):
    return t.parts.select("mail_id", "part_index", F.when(F.col("mail_id") % 10 != 0, F.col("outcome")).alias("outcome"))


@query("mut9_dispatch", "SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY owner_id ORDER BY delivery_id) AS r FROM deliveries WHERE event IN ('purchase', 'error')) WHERE r <= 50")
def mut9(t: Tables):
    r = F.row_number().over(Window.partitionBy("owner_id").orderBy("delivery_id"))
    return t.deliveries.filter("event IN ('purchase', 'error')").withColumn("r", r).filter("r <= 50").select("delivery_id")


@query("mut11_clamped_options", "SELECT p_partkey AS item_id, least(CASE WHEN p_size % 5 = 0 THEN 200 ELSE p_size * 9 END, 200) AS pages, least(coalesce(p_size, 10), 10) AS depth FROM part")
def mut11(t: Tables):
    s = F.col("p_size")
    return t.part.select(F.col("p_partkey").alias("item_id"), F.least(F.coalesce(F.when(s % 5 != 0, s * 9), F.lit(200)), F.lit(200)).alias("pages"), F.least(F.coalesce(s, F.lit(10)), F.lit(10)).alias("depth"))


# ------------------------------------------------------------------ sources and sinks


@query("src1_upload_verdict", """SELECT job_id, CASE WHEN lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) NOT IN ('.pdf', '.docx', '.pptx', '.xlsx', '.xls', '.png', '.jpg', '.jpeg', '.eml') THEN 'extension'
  WHEN upload_size > 30000000 THEN 'size' ELSE 'ok' END AS verdict FROM jobs""".replace("\\\\", "\\"))
def src1(t: Tables):
    from ..functions.paths import extension
    from ..sources.uploads import EXTENSIONS

    v = F.when(~extension(F.col("filename")).isin(*EXTENSIONS), "extension").when(F.col("upload_size") > 30_000_000, "size").otherwise("ok")
    return t.jobs.select("job_id", v.alias("verdict"))


@query("src10_capped_children", "SELECT parent, child FROM (SELECT l_suppkey AS parent, l_orderkey * 10 + l_linenumber AS child, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 50")
def src10(t: Tables):
    r = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return t.lineitem.withColumn("r", r).filter("r <= 50").select(F.col("l_suppkey").alias("parent"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child"))


@query("snk4_mail_export", "SELECT mail_id, count(*) AS n_parts, string_agg(CAST(part_index AS STRING) || ':' || outcome, ',' ORDER BY part_index, outcome) AS manifest FROM parts GROUP BY mail_id")
def snk4(t: Tables):
    p = F.sort_array(F.collect_list(F.struct("part_index", "outcome")))
    return t.parts.groupBy("mail_id").agg(F.count("*").alias("n_parts"), F.array_join(F.transform(p, lambda x: F.concat(x["part_index"].cast("string"), F.lit(":"), x["outcome"])), ",").alias("manifest"))


@query("snk6_previous_push", "SELECT push_id, coalesce(lag(push_id) OVER (PARTITION BY job_id, connection_id ORDER BY created_at, push_id), -1) AS previous FROM pushes WHERE status = 'finished'")
def snk6(t: Tables):
    w = Window.partitionBy("job_id", "connection_id").orderBy("created_at", "push_id")
    return t.pushes.filter("status = 'finished'").select("push_id", F.coalesce(F.lag("push_id").over(w), F.lit(-1).cast("long")).alias("previous"))


@query("snk8_file_tree", "SELECT folder || '/' || job_id || '/' || job_id || '.md' AS path, CAST(octet_length(encode(markdown)) AS INT) AS size FROM jobs WHERE status = 'FINISHED' AND coalesce(markdown, '') <> ''")
def snk8(t: Tables):
    j = F.col("job_id").cast("string")
    return t.jobs.filter("status = 'FINISHED' AND coalesce(markdown, '') <> ''").select(F.concat_ws("/", "folder", j, F.concat(j, F.lit(".md"))).alias("path"), F.octet_length("markdown").alias("size"))


@query("snk2_archive_names", "SELECT job_id, folder || '/' || regexp_replace(filename, '\\.[^.]+$', '') || '-' || job_id || '.md' AS name FROM jobs WHERE status = 'FINISHED'".replace("\\\\", "\\"))
def snk2(t: Tables):
    return t.jobs.filter("status = 'FINISHED'").select("job_id", F.concat("folder", F.lit("/"), F.regexp_replace("filename", r"\.[^.]+$", ""), F.lit("-"), F.col("job_id").cast("string"), F.lit(".md")).alias("name"))


@query("prs3_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def prs3(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
