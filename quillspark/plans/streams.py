"""Stream queries over events that arrive out of order in three slices; the stream restarts from its checkpoint between them.

An event arrives up to three days after it happened, one in forty twelve days after; a slice holds ten days of
arrivals. Four days are waited for, so some events are late and take no part. All queries append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import Cooldown, Lockout, RateLimit, SessionTouch
from ..streaming import events as S
from ..streaming.runs import Replayed, replay
from ..streaming.state import ordered_fold, session_changes, sessions_of
from .registry import Tables, query

LATE, SLICES = "4 days", 3

#: arr: events with their slice; wm: the watermark after each slice, in milliseconds; acc: events that are not late.
ARRIVALS = """arr AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS tick,
    least(2, (day(ts) - 1 + CASE WHEN event_id % 40 = 7 THEN 12 ELSE event_id % 4 END) // 10) AS slice FROM events),
  wm AS (SELECT slice, max(max(tick) // 1000) OVER (ORDER BY slice) - 4 * 86400000 AS wm FROM arr GROUP BY slice),
  seen AS (SELECT a.*, coalesce(w.wm, -9000000000000) * 1000 AS before, (SELECT max(wm) FROM wm) * 1000 AS final FROM arr a LEFT JOIN wm w ON w.slice = a.slice - 1)"""
ORDERED = f"{ARRIVALS}, ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS r FROM seen WHERE tick > before)"


def arrivals(t: Tables) -> list[DataFrame]:
    day = F.dayofmonth("ts") - 1 + F.when(F.col("event_id") % 40 == 7, 12).otherwise(F.col("event_id") % 4)
    rows = t.events.select("event_id", "user_id", "event_type", "ts").withColumn("slice", F.least(F.lit(SLICES - 1), F.floor(day / 10)))
    return [rows.filter(F.col("slice") == i).drop("slice") for i in range(SLICES)]


def _fold(t: Tables, by, flag=None) -> Replayed:
    return replay(t.spark, arrivals(t), lambda s: ordered_fold(s, "user_id", by, flag=flag, late=LATE))


@query("st1_rate_windows_stream", f"""WITH {ARRIVALS}, w AS (SELECT *, (tick // 3600000000 + 1) * 3600000000 AS closes FROM seen)
  SELECT user_id, make_timestamp(closes - 3600000000) AS opened, count(*) AS hits FROM w WHERE closes > before AND closes <= final GROUP BY ALL""")
def st1_stream(t: Tables):
    out = replay(t.spark, arrivals(t), lambda s: S.aligned_counts(s, "user_id", "1 hour", late=LATE)).rows
    return out.withColumn("opened", F.col("opened").cast("timestamp_ntz"))


@query("st6_sessions_stream", f"""WITH {ARRIVALS}, e AS (SELECT * FROM seen WHERE event_type = 'error'),
  m AS (SELECT slice, max(max(tick) // 1000) OVER (ORDER BY slice) - 4 * 86400000 AS wm FROM e GROUP BY slice),
  f AS (SELECT e.user_id, e.tick, (SELECT max(wm) FROM m) * 1000 AS final FROM e LEFT JOIN m ON m.slice = e.slice - 1 WHERE m.wm IS NULL OR e.tick + 172800000000 > m.wm * 1000),
  g AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick) < 172800000000 THEN 0 ELSE 1 END AS new FROM f),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, make_timestamp(min(tick)) AS first, count(*) AS n FROM s GROUP BY user_id, k, final HAVING max(tick) + 172800000000 <= final""")
def st6_stream(t: Tables):
    """Closed sessions; the watermark is that of the errors alone."""
    changes = replay(t.spark, arrivals(t), lambda s: session_changes(s.filter("event_type = 'error'"), "user_id", "2 days", late=LATE)).rows
    out = sessions_of(changes, "user_id")
    return out.withColumn("first", F.col("first").cast("timestamp_ntz"))


@query("st1_rate_limit_exact", f"""WITH RECURSIVE {ORDERED}, f AS (SELECT user_id, event_id, tick, r, final, tick AS opened, CAST(1 AS BIGINT) AS hits FROM ev WHERE r = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.tick, e.r, e.final, CASE WHEN e.tick >= f.opened + 259200000000 THEN e.tick ELSE f.opened END, CASE WHEN e.tick >= f.opened + 259200000000 THEN 1 ELSE f.hits + 1 END FROM f JOIN ev e ON e.user_id = f.user_id AND e.r = f.r + 1)
  SELECT user_id, tick, event_id, hits <= 4 AS allowed FROM f WHERE tick <= final""")
def st1_exact(t: Tables):
    """A window opens with the first hit."""
    return _fold(t, RateLimit(259_200, 4)).rows


@query("st7_session_stream", f"""WITH RECURSIVE {ORDERED}, go AS (SELECT user_id, event_id, tick, r, final, tick AS began, tick AS touched_at, tick + 432000000000 AS expires, true AS touched FROM ev WHERE r = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.tick, e.r, e.final, CASE WHEN e.tick >= g.expires THEN e.tick ELSE g.began END, CASE WHEN e.tick >= g.expires OR e.tick - g.touched_at > 86400000000 THEN e.tick ELSE g.touched_at END,
      CASE WHEN e.tick >= g.expires THEN e.tick + 432000000000 WHEN e.tick - g.touched_at > 86400000000 THEN least(e.tick + 432000000000, g.began + 864000000000) ELSE g.expires END, e.tick >= g.expires OR e.tick - g.touched_at > 86400000000
    FROM go g JOIN ev e ON e.user_id = g.user_id AND e.r = g.r + 1)
  SELECT user_id, tick, event_id, began, touched, expires FROM go WHERE tick <= final""")
def st7_stream(t: Tables):
    """Touched after a day, five days from a touch, ten at most."""
    return _fold(t, SessionTouch(86_400, 5 * 86_400, 10 * 86_400)).rows


@query("st6_lockout_stream", f"""WITH RECURSIVE {ORDERED}, go AS (SELECT user_id, event_id, tick, r, final, CASE WHEN event_type <> 'signup' THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN event_type <> 'signup' THEN 1 ELSE 0 END AS n, CASE WHEN event_type <> 'signup' THEN tick END AS last, CAST(NULL AS BIGINT) AS until FROM ev WHERE r = 1 UNION ALL
    SELECT user_id, event_id, tick, r, final, CASE WHEN locked THEN 'refused' WHEN NOT failed THEN 'ok' WHEN k >= 4 THEN 'locked' ELSE 'failed' END, CASE WHEN locked THEN n WHEN NOT failed OR k >= 4 THEN 0 ELSE k END,
      CASE WHEN locked THEN last WHEN failed THEN tick END, CASE WHEN locked THEN until WHEN failed AND k >= 4 THEN tick + 86400000000 END
    FROM (SELECT e.user_id, e.event_id, e.tick, e.r, e.final, e.event_type <> 'signup' AS failed, g.n, g.last, g.until, coalesce(e.tick < g.until, false) AS locked, CASE WHEN g.last IS NULL OR e.tick - g.last > 259200000000 THEN 1 ELSE g.n + 1 END AS k FROM go g JOIN ev e ON e.user_id = g.user_id AND e.r = g.r + 1))
  SELECT user_id, tick, event_id, outcome, CAST(n AS BIGINT) AS count FROM go WHERE tick <= final""")
def st6_lockout(t: Tables):
    return _fold(t, Lockout(4, 259_200, 86_400), F.col("event_type") != "signup").rows


@query("mut10_cooldown_stream", f"""WITH RECURSIVE {ORDERED}, go AS (SELECT user_id, event_id, tick, r, final, true AS accepted, tick AS held FROM ev WHERE r = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.tick, e.r, e.final, e.tick - g.held >= 86400000000, CASE WHEN e.tick - g.held >= 86400000000 THEN e.tick ELSE g.held END FROM go g JOIN ev e ON e.user_id = g.user_id AND e.r = g.r + 1)
  SELECT user_id, tick, event_id, accepted FROM go WHERE tick <= final""")
def mut10_stream(t: Tables):
    return _fold(t, Cooldown(86_400)).rows


@query("st7_late_rows", f"WITH {ARRIVALS} SELECT count(*) FILTER (tick <= before) AS late, count(*) FILTER (tick > before AND tick <= final) AS decided, count(*) FILTER (tick > before AND tick > final) AS waiting FROM seen")
def st7_late(t: Tables):
    """What became of all arrivals: too late, decided, or still inside the watermark's delay."""
    done = _fold(t, Cooldown(86_400))
    late, total = F.lit(done.late).cast("long"), t.events.filter("ts IS NOT NULL").count()
    return done.rows.agg(late.alias("late"), F.count("*").alias("decided"), (F.lit(total) - late - F.count("*")).alias("waiting"))
