"""Listing, filtering, projection, join, aggregate and ordering queries over the job relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import visibility as V
from ..operators.joins import left_known
from ..operators.selection import kth_largest
from ..operators.sketches import DISTINCT_ERROR, RANK_ERROR, by_day, merged, read_off
from ..storage import stored
from .registry import Tables, query

VISIBLE = """owners AS (SELECT user_id AS viewer_id, user_id AS owner_id FROM users UNION
  SELECT a.user_id, b.user_id FROM users a JOIN users b ON a.team_id = b.team_id)"""
PATH = """coalesce(nullif(array_to_string(list_filter(list_transform(string_split(replace(concat_ws('/', folder, subfolder), '\\', '/'), '/'), lambda x: trim(x)), lambda x: x <> ''), '/'), ''),
  nullif(array_to_string(string_split(storage_folder, '/')[1:-2], '/'), ''), 'inbox')"""


def with_path(jobs):
    return jobs.withColumn("path", paths.folder_path(F.col("folder"), F.col("subfolder"), F.col("storage_folder")))


# ------------------------------------------------------------------ filters


@query("flt1_visibility", f"WITH {VISIBLE} SELECT viewer_id, job_id FROM jobs JOIN owners USING (owner_id) JOIN users u ON u.user_id = viewer_id AND u.role <> 'admin'")
def flt1(t: Tables):
    return V.visible_pairs(t.jobs.select("job_id", "owner_id"), t.users).select("viewer_id", "job_id")


@query("flt1_visible_to_one", f"WITH {VISIBLE} SELECT job_id FROM jobs WHERE owner_id IN (SELECT owner_id FROM owners WHERE viewer_id = 7)")
def flt1_one(t: Tables):
    return V.visible(t.jobs, t.users, 7).select("job_id")


@query("flt2_browsable", "SELECT job_id FROM jobs WHERE run_id IS NULL")
def flt2(t: Tables):
    return V.browsable(t.jobs).select("job_id")


@query("flt3_search", "SELECT job_id, filename FROM jobs WHERE lower(filename) LIKE '%c 1_.d%'")
def flt3(t: Tables):
    return t.jobs.filter(V.like_ci("filename", "C 1_.D")).select("job_id", "filename")


@query("flt4_by_tag", "SELECT DISTINCT j.job_id FROM jobs j JOIN job_tags b ON b.job_id = j.job_id JOIN tags g ON g.tag_id = b.tag_id WHERE g.name = 'brazil' OR g.name = 'nation_2'")
def flt4(t: Tables):
    wanted = t.tags.filter(F.lower("name").isin("brazil", "nation_2"))
    return t.jobs.join(t.job_tags.join(wanted, "tag_id"), "job_id", "left_semi").select("job_id")


@query("flt5_date_range", "SELECT job_id FROM jobs WHERE created_at >= TIMESTAMP '1995-01-01 00:00:00' AND created_at <= TIMESTAMP '1996-06-30 23:59:59.999999'")
def flt5(t: Tables):
    return t.jobs.filter("created_at >= TIMESTAMP_NTZ '1995-01-01' AND created_at < TIMESTAMP_NTZ '1996-07-01'").select("job_id")


@query("flt6_status_chips", "SELECT CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'running' WHEN status = 'FINISHED' THEN 'completed' ELSE 'failed' END AS chip, count(*) AS n FROM jobs GROUP BY 1")
def flt6(t: Tables):
    return t.jobs.groupBy(V.status_chip(F.col("status")).alias("chip")).agg(F.count("*").alias("n"))


@query("flt7_folder_prefix", f"SELECT job_id, path FROM (SELECT job_id, {PATH} AS path FROM jobs) WHERE path = 'F1' OR starts_with(path, 'F1/')")
def flt7(t: Tables):
    return with_path(t.jobs).filter(V.in_folder(F.col("path"), "F1")).select("job_id", "path")


@query("flt8_log_floor", "SELECT event_id, level FROM logs WHERE level IN ('WARNING', 'ERROR', 'CRITICAL')")
def flt8(t: Tables):
    levels = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
    return t.logs.filter(F.col("level").isin(levels[levels.index("WARNING") :])).select("event_id", "level")


@query("flt9_exact", "SELECT event_id FROM logs WHERE worker = 'worker-2' AND created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-20'")
def flt9(t: Tables):
    return t.logs.filter("worker = 'worker-2' AND created_at >= TIMESTAMP_NTZ '2024-01-10' AND created_at <= TIMESTAMP_NTZ '2024-01-20'").select("event_id")


@query("flt10_due_for_refresh", "SELECT source_id FROM sources WHERE enabled AND (since_s IS NULL OR since_s >= greatest(coalesce(interval_s, 900), 900))")
def flt10(t: Tables):
    return t.sources.filter(F.col("enabled") & (F.col("since_s").isNull() | (F.col("since_s") >= F.greatest(F.coalesce("interval_s", F.lit(900)), F.lit(900))))).select("source_id")


@query("flt11_stale_active", "SELECT job_id FROM jobs WHERE status IN ('PENDING', 'RUNNING') AND idle_s > 600")
def flt11(t: Tables):
    return t.jobs.filter(F.col("status").isin("PENDING", "RUNNING") & (F.col("idle_s") > 600)).select("job_id")


@query(
    "flt12_push_eligibility",
    f"""WITH {VISIBLE}, asked AS (SELECT l_orderkey + (l_linenumber % 2) * 3 AS job_id, min(l_orderkey * 8 + l_linenumber) AS pos FROM lineitem GROUP BY 1)
    SELECT a.job_id, a.pos, CASE WHEN j.job_id IS NULL THEN 'not_found' WHEN j.status <> 'FINISHED' OR coalesce(j.markdown, '') = '' THEN 'not_ready' ELSE 'ready' END AS verdict
    FROM asked a LEFT JOIN (SELECT * FROM jobs WHERE owner_id IN (SELECT owner_id FROM owners WHERE viewer_id = 3)) j USING (job_id)""",
)
def flt12(t: Tables):
    asked = t.lineitem.select((F.col("l_orderkey") + (F.col("l_linenumber") % 2) * 3).alias("job_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    asked = asked.groupBy("job_id").agg(F.min("pos").alias("pos"))
    mine = V.visible(t.jobs, t.users, 3).select("job_id", "status", "markdown")
    verdict = F.when(F.col("status").isNull(), "not_found").when((F.col("status") != "FINISHED") | (F.coalesce("markdown", F.lit("")) == ""), "not_ready").otherwise("ready")
    return asked.join(mine, "job_id", "left").select("job_id", "pos", verdict.alias("verdict"))


@query("flt14_restartable", "SELECT job_id FROM jobs WHERE mode <> 'import'")
def flt14(t: Tables):
    return t.jobs.filter("mode <> 'import'").select("job_id")


# ------------------------------------------------------------------ projections


@query("prj1_folder_path", f"SELECT job_id, {PATH} AS path FROM jobs")
def prj1(t: Tables):
    return with_path(t.jobs).select("job_id", "path")


@query("prj2_path_sanitiser", r"""SELECT item_id, CASE WHEN NOT list_contains(p, '..') AND NOT list_contains(p, '.') THEN array_to_string(p, '/') END AS path FROM
  (SELECT item_id, list_filter(list_transform(string_split(replace(raw, '\', '/'), '/'), lambda x: trim(x)), lambda x: x <> '') AS p FROM
    (SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN ' a \b//c ' WHEN 1 THEN '../' || p_brand WHEN 2 THEN p_type || '/ /' || p_name ELSE '/./x' END AS raw FROM part))""")
def prj2(t: Tables):
    raw = F.expr(r"CASE p_partkey % 4 WHEN 0 THEN ' a \\b//c ' WHEN 1 THEN '../' || p_brand WHEN 2 THEN p_type || '/ /' || p_name ELSE '/./x' END")
    return t.part.select(F.col("p_partkey").alias("item_id"), paths.clean_path(raw).alias("path"))


@query("prj3_page_count", "SELECT job_id, coalesce(page_count, structure_pages, 1) AS pages FROM jobs")
def prj3(t: Tables):
    return t.jobs.select("job_id", F.coalesce("page_count", "structure_pages", F.lit(1)).alias("pages"))


@query("prj4_profile_precedence", "SELECT job_id, CASE WHEN starts_with(profile_id, 'vl:') THEN profile_id WHEN duration_s > 200 THEN 'large' ELSE coalesce(profile_id, '-') END AS profile FROM jobs")
def prj4(t: Tables):
    executed = F.when(F.col("duration_s") > 200, "large")
    return t.jobs.select("job_id", F.coalesce(F.when(F.col("profile_id").startswith("vl:"), F.col("profile_id")), executed, "profile_id", F.lit("-")).alias("profile"))


@query("prj5_job_type", "SELECT job_id, CASE WHEN mode IN ('import', 'import_attachment') THEN 'import' WHEN mode = 'mail_attachment' THEN 'mail' WHEN mode = 'collection' THEN 'collection' ELSE 'single' END AS kind FROM jobs")
def prj5(t: Tables):
    return t.jobs.select("job_id", job_kind().alias("kind"))


def job_kind():
    m = F.col("mode")
    return F.when(m.isin("import", "import_attachment"), "import").when(m == "mail_attachment", "mail").when(m == "collection", "collection").otherwise("single")


@query("prj6_pipeline", "SELECT job_id, CASE WHEN starts_with(profile_id, 'vl:') THEN 'openai_vision' WHEN profile_id IN ('tiny', 'small', 'medium') THEN profile_id ELSE 'small' END AS pipeline FROM jobs")
def prj6(t: Tables):
    p = F.col("profile_id")
    return t.jobs.select("job_id", F.when(p.startswith("vl:"), "openai_vision").when(p.isin("tiny", "small", "medium"), p).otherwise("small").alias("pipeline"))


LOWER = {"medium_structured": "medium", "medium": "small_structured", "small_structured": "small", "small": "tiny"}


@query("prj7_lower_profile", "SELECT job_id, CASE profile_id WHEN 'medium_structured' THEN 'medium' WHEN 'medium' THEN 'small_structured' WHEN 'small_structured' THEN 'small' WHEN 'small' THEN 'tiny' END AS lower_profile FROM jobs")
def prj7(t: Tables):
    table = F.create_map(*[F.lit(x) for pair in LOWER.items() for x in pair])
    return t.jobs.select("job_id", F.try_element_at(table, "profile_id").alias("lower_profile"))


@query("prj8_status_against_active", "SELECT job_id, CASE WHEN status = 'RUNNING' AND job_id % 2 = 1 THEN 'PENDING' ELSE status END AS status FROM jobs")
def prj8(t: Tables):
    active = t.jobs.filter("job_id % 2 = 0").select("job_id", F.lit(True).alias("active"))
    return t.jobs.join(active, "job_id", "left").select("job_id", F.when((F.col("status") == "RUNNING") & F.col("active").isNull(), "PENDING").otherwise(F.col("status")).alias("status"))


@query("prj9_tag_parse", r"""SELECT item_id, array_to_string(list_transform(list_filter(list_zip(p, range(len(p))), lambda x: x[1] <> '' AND list_position(p, x[1]) = x[2] + 1), lambda x: x[1]), '|') AS tags
  FROM (SELECT p_partkey AS item_id, list_transform(string_split(replace(p_type || ', ' || p_brand || chr(10) || ' ' || upper(p_type) || ' ,,B' || CAST(p_partkey % 3 AS STRING), chr(10), ','), ','), lambda x: lower(trim(x))) AS p FROM part)""")
def prj9(t: Tables):
    raw = F.concat("p_type", F.lit(", "), "p_brand", F.lit("\n "), F.upper("p_type"), F.lit(" ,,B"), (F.col("p_partkey") % 3).cast("string"))
    return t.part.select(F.col("p_partkey").alias("item_id"), F.array_join(paths.tag_list(raw), "|").alias("tags"))


@query(
    "prj10_chunk_ranges",
    """WITH s AS (SELECT job_id, pages, greatest(1, CASE WHEN p = 'medium' AND pages >= 20 THEN 1 WHEN p = 'medium' AND pages >= 12 THEN least(base, 2)
        WHEN p = 'small' AND pages >= 40 THEN least(base, 2) WHEN p = 'small' AND pages >= 24 THEN least(base, 3) ELSE base END) AS size FROM (
      SELECT job_id, job_id % 50 + 1 AS pages, profile_id AS p, CASE profile_id WHEN 'tiny' THEN 8 WHEN 'small' THEN 4 WHEN 'medium' THEN 2 WHEN 'medium_structured' THEN 2 ELSE 6 END AS base FROM jobs))
    SELECT job_id, a AS first_page, least(a + size - 1, pages) AS last_page FROM (SELECT *, unnest(generate_series(1, pages, size)) AS a FROM s)""",
)
def prj10(t: Tables):
    p, pages = F.col("profile_id"), F.col("pages")
    base = F.when(p == "tiny", 8).when(p == "small", 4).when(p.isin("medium", "medium_structured"), 2).otherwise(6)
    size = (
        F.when((p == "medium") & (pages >= 20), 1).when((p == "medium") & (pages >= 12), F.least(base, F.lit(2)))
        .when((p == "small") & (pages >= 40), F.least(base, F.lit(2))).when((p == "small") & (pages >= 24), F.least(base, F.lit(3))).otherwise(base)
    )
    rows = t.jobs.withColumn("pages", F.col("job_id") % 50 + 1).withColumn("size", F.greatest(F.lit(1), size).cast("long"))
    rows = rows.select("job_id", "pages", "size", F.explode(F.sequence(F.lit(1).cast("long"), pages, F.col("size"))).alias("first_page"))
    return rows.select("job_id", "first_page", F.least(F.col("first_page") + F.col("size") - 1, pages).alias("last_page"))


@query("prj11_import_folder", r"""SELECT item_id, 'imports/' || coalesce(nullif(substr(lower(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 80), ''), 'page') AS folder
  FROM (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 10 = 0 THEN '?!' ELSE '(' || p_name || ') / ' || p_type END AS title FROM part)""")
def prj11(t: Tables):
    title = F.when(F.col("p_partkey") % 10 == 0, "?!").otherwise(F.concat(F.lit("("), "p_name", F.lit(") / "), "p_type"))
    return t.part.select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("imports/"), paths.slug(title)).alias("folder"))


@query("prj12_mail_parts_summary", """SELECT mail_id, concat_ws(', ', CASE WHEN j > 0 THEN CAST(j AS STRING) || CASE WHEN j = 1 THEN ' document' ELSE ' documents' END END,
    CASE WHEN i > 0 THEN CAST(i AS STRING) || ' inline' END, CASE WHEN s > 0 THEN CAST(s AS STRING) || ' skipped' END) AS summary
  FROM (SELECT mail_id, count(*) FILTER (outcome = 'job') AS j, count(*) FILTER (outcome = 'inline') AS i, count(*) FILTER (outcome = 'skipped') AS s FROM parts GROUP BY 1)""")
def prj12(t: Tables):
    n = {k: F.count_if(F.col("outcome") == k) for k in ("job", "inline", "skipped")}
    c = t.parts.groupBy("mail_id").agg(*[v.alias(k) for k, v in n.items()])
    docs = F.when(F.col("job") > 0, F.concat(F.col("job").cast("string"), F.when(F.col("job") == 1, " document").otherwise(" documents")))
    rest = [F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {k}"))) for k in ("inline", "skipped")]
    return c.select("mail_id", F.concat_ws(", ", docs, *rest).alias("summary"))


@query("prj13_format_bytes", """SELECT job_id, CASE WHEN n < 1024 THEN CAST(n AS STRING) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE)
    WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS shown FROM (SELECT job_id, upload_size * (job_id % 900) // 7 AS n FROM jobs)""")
def prj13(t: Tables):

    return t.jobs.select("job_id", paths.byte_size(F.expr("upload_size * (job_id % 900) div 7")).alias("shown"))


# ------------------------------------------------------------------ joins


@query("jn1_owner_names", "SELECT job_id, username FROM jobs LEFT JOIN users ON user_id = owner_id")
def jn1(t: Tables):
    return left_known(t.jobs.select("job_id", "owner_id"), t.users.select(F.col("user_id").alias("owner_id"), "username"), "owner_id").select("job_id", "username")


@query("jn2_tags_of_jobs", "SELECT job_id, string_agg(name, ',' ORDER BY name) AS names FROM job_tags JOIN tags USING (tag_id) GROUP BY job_id")
def jn2(t: Tables):
    return t.job_tags.join(t.tags, "tag_id").groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query("jn4_mail_part_jobs", "SELECT p.mail_id, p.part_index, j.status FROM parts p LEFT JOIN jobs j ON j.job_id = p.job_id")
def jn4(t: Tables):
    return left_known(t.parts.select("mail_id", "part_index", "job_id"), t.jobs.select("job_id", "status"), "job_id").select("mail_id", "part_index", "status")


@query("jn5_job_owner_team", "SELECT job_id, username, r_name AS team FROM jobs LEFT JOIN users ON user_id = owner_id LEFT JOIN region ON r_regionkey = team_id")
def jn5(t: Tables):
    out = left_known(t.jobs.select("job_id", "owner_id"), t.users.select(F.col("user_id").alias("owner_id"), "username", "team_id"), "owner_id").join(t.region, F.col("team_id") == F.col("r_regionkey"), "left")
    return out.select("job_id", "username", F.col("r_name").alias("team"))


@query("jn7_run_variants", "SELECT run_id, count(*) AS variants, CAST(sum(upload_size) AS BIGINT) AS bytes FROM jobs WHERE run_id IS NOT NULL GROUP BY run_id")
def jn7(t: Tables):
    return t.jobs.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("variants"), F.sum("upload_size").alias("bytes"))


@query("jn8_orphans", "SELECT push_id FROM pushes WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'FINISHED')")
def jn8(t: Tables):
    return t.pushes.join(t.jobs.filter("status = 'FINISHED'"), "job_id", "left_anti").select("push_id")


# ------------------------------------------------------------------ aggregates


@query("agg1_counts", "SELECT count(*) FILTER (status = 'FINISHED') AS finished, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running FROM jobs")
def agg1(t: Tables):
    return t.jobs.agg(*[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("finished", "failed", "pending", "running")])


@query("agg2_distinct_jobs_by_tag", "SELECT name, count(DISTINCT job_id) AS jobs FROM job_tags JOIN tags USING (tag_id) GROUP BY name")
def agg2(t: Tables):
    return t.job_tags.join(t.tags, "tag_id").groupBy("name").agg(F.countDistinct("job_id").alias("jobs"))


@query("agg2_sketched_days", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close FROM events GROUP BY event_type")
def agg2_sketched(t: Tables):
    """Stored sketches of single days, merged: distinct users within three standard errors, the median's rank within its bound."""
    days = stored(by_day(t.events, ["event_type"], "ts", "user_id", "value"))
    found = read_off(merged(days, ["event_type"])).select("event_type", "distinct", F.col("quantiles")[0].alias("median"))
    exact = t.events.join(found, "event_type").groupBy("event_type", "distinct").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("double")).alias("upto")
    )
    close = F.abs(F.col("distinct") - F.col("users")) <= F.col("users") * 3 * DISTINCT_ERROR + 1
    return exact.select("event_type", "n", "users", close.alias("users_close"), ((F.col("below") <= 0.5 + RANK_ERROR) & (F.col("upto") >= 0.5 - RANK_ERROR)).alias("median_close"))


@query("agg3_dashboard", "SELECT count(*) FILTER (status = 'FINISHED') AS documents, CAST(sum(coalesce(page_count, structure_pages)) FILTER (status = 'FINISHED') AS BIGINT) AS pages, count(*) FILTER (status = 'FAILED') AS failed, CAST(sum(upload_size) AS BIGINT) AS bytes FROM jobs")
def agg3(t: Tables):
    done = F.col("status") == "FINISHED"
    return t.jobs.agg(F.count_if(done).alias("documents"), F.sum(F.when(done, F.coalesce("page_count", "structure_pages"))).alias("pages"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum("upload_size").alias("bytes"))


@query("agg4_payload_bytes", "SELECT CAST(sum(coalesce(upload_size, 0)) + sum(coalesce(length(markdown), 0)) + (SELECT sum(coalesce(size_bytes, 0)) FROM parts) AS BIGINT) AS bytes FROM jobs")
def agg4(t: Tables):
    a = t.jobs.agg((F.sum(F.coalesce("upload_size", F.lit(0))) + F.sum(F.coalesce(F.length("markdown"), F.lit(0)))).alias("n"))
    return a.unionByName(t.parts.agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("n"))).agg(F.sum("n").alias("bytes"))


@query("agg5_run_status_pivot", "SELECT run_id, count(*) FILTER (status = 'FINISHED') AS finished, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running FROM jobs WHERE run_id IS NOT NULL GROUP BY run_id")
def agg5(t: Tables):
    names = ["FINISHED", "FAILED", "PENDING", "RUNNING"]
    p = t.jobs.filter("run_id IS NOT NULL").groupBy("run_id").pivot("status", names).count()
    return p.select("run_id", *[F.coalesce(n, F.lit(0)).alias(n.lower()) for n in names])


@query("agg6_next_version", "SELECT name_no, owner_id, max(body) + 1 AS next_version FROM jobs WHERE owner_id IS NOT NULL GROUP BY name_no, owner_id")
def agg6(t: Tables):
    return t.jobs.filter("owner_id IS NOT NULL").groupBy("name_no", "owner_id").agg((F.max("body") + 1).alias("next_version"))


@query(
    "agg7_folder_tree",
    f"""WITH p AS (SELECT string_split({PATH}, '/') AS s FROM jobs), e AS (SELECT s, unnest(range(1, len(s) + 1)) AS d FROM p)
    SELECT array_to_string(s[1:d], '/') AS path, s[d] AS name, CAST(d AS INT) AS depth, count(*) AS n FROM e GROUP BY 1, 2, 3""",
)
def agg7(t: Tables):
    s = with_path(t.jobs).select(F.split("path", "/").alias("s"))
    each = s.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"))
    keys = each.select(F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/").alias("path"), F.element_at("s", F.col("depth")).alias("name"), "depth")
    return keys.groupBy("path", "name", "depth").agg(F.count("*").alias("n"))


@query("agg9_type_counts", "SELECT CASE WHEN mode IN ('import', 'import_attachment') THEN 'import' WHEN mode = 'mail_attachment' THEN 'mail' WHEN mode = 'collection' THEN 'collection' ELSE 'single' END AS kind, count(*) AS n FROM jobs GROUP BY 1")
def agg9(t: Tables):
    return t.jobs.groupBy(job_kind().alias("kind")).agg(F.count("*").alias("n"))


@query("agg12_subfolders", f"SELECT top, string_agg(sub, ',' ORDER BY sub) AS subs FROM (SELECT DISTINCT split_part(path, '/', 1) AS top, split_part(path, '/', 2) AS sub FROM (SELECT {PATH} AS path FROM jobs)) WHERE sub <> '' GROUP BY top")
def agg12(t: Tables):
    s = with_path(t.jobs).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("top"), F.split_part("path", F.lit("/"), F.lit(2)).alias("sub")).filter("sub <> ''")
    return s.groupBy("top").agg(F.array_join(F.sort_array(F.collect_set("sub")), ",").alias("subs"))


@query("agg15_pending_per_owner", "SELECT owner_id, count(*) FILTER (http_status IN (0, 500, 503)) AS pending FROM deliveries GROUP BY owner_id HAVING count(*) FILTER (http_status IN (0, 500, 503)) >= 50")
def agg15(t: Tables):
    return t.deliveries.groupBy("owner_id").agg(F.count_if(F.col("http_status").isin(0, 500, 503)).alias("pending")).filter("pending >= 50")


@query("agg16_run_status", """SELECT run_id, CASE WHEN bool_and(status = 'PENDING') THEN 'pending' WHEN bool_and(status IN ('FINISHED', 'FAILED')) THEN CASE WHEN bool_or(status = 'FINISHED') THEN 'completed' ELSE 'failed' END ELSE 'running' END AS run_status
  FROM jobs WHERE run_id IS NOT NULL GROUP BY run_id""")
def agg16(t: Tables):
    s = F.col("status")
    g = t.jobs.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.bool_and(s == "PENDING").alias("p"), F.bool_and(s.isin("FINISHED", "FAILED")).alias("d"), F.bool_or(s == "FINISHED").alias("f"))
    return g.select("run_id", F.when(F.col("p"), "pending").when(F.col("d") & F.col("f"), "completed").when(F.col("d"), "failed").otherwise("running").alias("run_status"))


@query("agg17_winners", """SELECT run_id, (SELECT job_id FROM jobs f WHERE f.run_id = r.run_id AND f.status = 'FINISHED' AND NOT f.used_fallback ORDER BY f.duration_s, f.created_at, f.job_id LIMIT 1) AS fastest,
    (SELECT job_id FROM jobs f WHERE f.run_id = r.run_id AND f.status = 'FINISHED' AND NOT f.used_fallback AND f.grade IS NOT NULL ORDER BY f.grade, f.created_at, f.job_id LIMIT 1) AS best
  FROM (SELECT DISTINCT run_id FROM jobs WHERE run_id IS NOT NULL) r""")
def agg17(t: Tables):
    ok = (F.col("status") == "FINISHED") & ~F.col("used_fallback")
    fast = F.min(F.when(ok, F.struct("duration_s", "created_at", "job_id")))
    best = F.min(F.when(ok & F.col("grade").isNotNull(), F.struct("grade", "created_at", "job_id")))
    return t.jobs.filter("run_id IS NOT NULL").groupBy("run_id").agg(fast["job_id"].alias("fastest"), best["job_id"].alias("best"))


@query("agg18_mail_complete", "SELECT mail_id, coalesce(bool_and(status IN ('FINISHED', 'FAILED')), true) AS complete FROM parts p LEFT JOIN jobs j ON j.job_id = p.job_id GROUP BY mail_id")
def agg18(t: Tables):
    j = left_known(t.parts.select("mail_id", "job_id"), t.jobs.select("job_id", "status"), "job_id")
    return j.groupBy("mail_id").agg(F.coalesce(F.bool_and(F.col("status").isin("FINISHED", "FAILED")), F.lit(True)).alias("complete"))


@query("agg19_children_titles", "SELECT n_regionkey AS parent, string_agg(n_name, '|' ORDER BY n_nationkey) AS titles FROM nation GROUP BY n_regionkey")
def agg19(t: Tables):
    a = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return t.nation.groupBy(F.col("n_regionkey").alias("parent")).agg(F.array_join(F.transform(a, lambda x: x["n_name"]), "|").alias("titles"))


@query("agg20_run_counters", "SELECT mail_id AS run_id, count(*) AS discovered, count(*) FILTER (outcome = 'job') AS imported, count(*) FILTER (outcome = 'skipped') AS failed, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM parts GROUP BY mail_id")
def agg20(t: Tables):
    o = F.col("outcome")
    return t.parts.groupBy(F.col("mail_id").alias("run_id")).agg(F.count("*").alias("discovered"), F.count_if(o == "job").alias("imported"), F.count_if(o == "skipped").alias("failed"), F.sum("size_bytes").alias("bytes"))


@query("agg21_queue_totals", "SELECT p + greatest(r - 3, 0) AS pending, least(r, 3) AS running FROM (SELECT count(*) FILTER (status = 'PENDING') AS p, count(*) FILTER (status = 'RUNNING') AS r FROM jobs)")
def agg21(t: Tables):
    c = t.jobs.agg(F.count_if(F.col("status") == "PENDING").alias("p"), F.count_if(F.col("status") == "RUNNING").alias("r"))
    return c.select((F.col("p") + F.greatest(F.col("r") - 3, F.lit(0))).alias("pending"), F.least("r", F.lit(3).cast("long")).alias("running"))


# ------------------------------------------------------------------ ordering, top-k, windows


@query("ord1_page_with_total", "SELECT job_id, (SELECT count(*) FROM jobs) AS total FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 100")
def ord1(t: Tables):
    total = t.jobs.agg(F.count("*").alias("total"))
    page = t.jobs.select("job_id", "created_at").orderBy(F.desc("created_at"), F.desc("job_id")).offset(100).limit(50)
    return page.join(F.broadcast(total)).select("job_id", "total")


@query("ord2_logs", "SELECT event_id, level FROM logs ORDER BY created_at DESC, event_id DESC LIMIT 200")
def ord2(t: Tables):
    return t.logs.orderBy(F.desc("created_at"), F.desc("event_id")).limit(200).select("event_id", "level")


@query("ord3_predecessor", "SELECT filename, job_id FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY body DESC, created_at DESC, job_id DESC) AS r FROM jobs WHERE run_id IS NULL AND mode <> 'mail_attachment') WHERE r = 1")
def ord3(t: Tables):
    j = t.jobs.filter("run_id IS NULL AND mode <> 'mail_attachment'")
    return j.groupBy("filename").agg(F.max(F.struct("body", "created_at", "job_id"))["job_id"].alias("job_id"))


@query("ord5_client_sort", "SELECT job_id, row_number() OVER (ORDER BY lower(status) DESC, lower(filename) DESC, job_id) AS pos FROM jobs WHERE owner_id = 4")
def ord5(t: Tables):
    own = t.jobs.filter("owner_id = 4")
    return own.select("job_id", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.lower("status").desc(), F.lower("filename").desc(), "job_id")).cast("long").alias("pos"))


@query("ord6_pages", "SELECT owner_id, job_id, CAST(ceil(row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, job_id) / 50.0::DOUBLE) AS BIGINT) AS page FROM jobs WHERE owner_id IS NOT NULL")
def ord6(t: Tables):
    r = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("created_at"), "job_id"))
    return t.jobs.filter("owner_id IS NOT NULL").select("owner_id", "job_id", F.ceil(r / 50.0).alias("page"))


@query("ord7_failed_first", "SELECT job_id FROM jobs WHERE status = 'FAILED' ORDER BY (owner_id IS NOT DISTINCT FROM 5) DESC, created_at DESC, job_id LIMIT 5")
def ord7(t: Tables):
    return t.jobs.filter("status = 'FAILED'").orderBy(F.col("owner_id").eqNullSafe(5).desc(), F.desc("created_at"), "job_id").limit(5).select("job_id")


@query("ord8_retention", "SELECT event_id FROM logs WHERE created_at >= coalesce((SELECT created_at FROM logs ORDER BY created_at DESC, event_id DESC LIMIT 1 OFFSET 2000), TIMESTAMP '1900-01-01')")
def ord8(t: Tables):
    """The 2,001st newest time, by refined histograms, and all that is not older; fewer records stay as they are."""
    logs = t.logs.select("event_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.lit(0).alias("all"))
    cut = kth_largest(logs, ["all"], "at", 2001).agg(F.max("cutoff").alias("cut"))  # one row
    return logs.join(F.broadcast(cut)).filter("cut IS NULL OR at >= cut").select("event_id")


@query("ord9_latest_push", "SELECT job_id, connection_id, push_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, connection_id ORDER BY created_at DESC, push_id DESC) AS r FROM pushes WHERE status = 'finished') WHERE r = 1")
def ord9(t: Tables):
    return t.pushes.filter("status = 'finished'").groupBy("job_id", "connection_id").agg(F.max(F.struct("created_at", "push_id"))["push_id"].alias("push_id"))


@query("ord10_admission", "SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, job_id) AS r FROM jobs WHERE status IN ('PENDING', 'RUNNING') AND owner_id IS NOT NULL) WHERE r <= 3")
def ord10(t: Tables):
    r = F.row_number().over(Window.partitionBy("owner_id").orderBy("created_at", "job_id"))
    return t.jobs.filter("status IN ('PENDING', 'RUNNING') AND owner_id IS NOT NULL").withColumn("r", r).filter("r <= 3").select("job_id")


@query("ord12_is_current", f"""WITH {VISIBLE}, v AS (SELECT viewer_id, filename, body, job_id FROM jobs JOIN owners USING (owner_id))
  SELECT viewer_id, job_id, body = max(body) OVER (PARTITION BY viewer_id, filename) AS is_current FROM v""")
def ord12(t: Tables):
    v = t.jobs.join(V.allowed_owners(t.users), "owner_id")
    return v.select("viewer_id", "job_id", (F.col("body") == F.max("body").over(Window.partitionBy("viewer_id", "filename"))).alias("is_current"))


@query("ord13_dedup_names", r"SELECT mail_id, part_index, CASE WHEN r = 1 THEN f ELSE regexp_replace(f, '(\.[^.]+)$', '-' || CAST(r AS STRING) || '\1') END AS name FROM (SELECT mail_id, part_index, f, row_number() OVER (PARTITION BY mail_id, f ORDER BY part_index) AS r FROM (SELECT *, coalesce(filename, 'part.pdf') AS f FROM parts))")
def ord13(t: Tables):
    p = t.parts.withColumn("f", F.coalesce("filename", F.lit("part.pdf"))).withColumn("r", F.row_number().over(Window.partitionBy("mail_id", "f").orderBy("part_index")))
    ext = F.regexp_extract("f", r"(\.[^.]+)$", 1)
    stem = F.expr("left(f, length(f) - length(regexp_extract(f, '([.][^.]+)$', 1)))")
    return p.select("mail_id", "part_index", F.when(F.col("r") == 1, F.col("f")).otherwise(F.concat(stem, F.lit("-"), F.col("r").cast("string"), ext)).alias("name"))
