"""Ordered folds on streams: out-of-order slices, restarts, late rows, and the same folds in batch against plain loops."""

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import folds
from quillspark.streaming.runs import replay
from quillspark.streaming.state import ordered_fold, session_changes, sessions_of

START = datetime(2024, 1, 1, tzinfo=UTC)
MICROS = 1_000_000


def loop(by, events):
    """One event at a time: ascending (tick, flag) -> the fold's columns, by the rules in words."""
    out, state = [], None
    for tick, failed in events:
        if isinstance(by, folds.Cooldown):
            ok = state is None or tick - state >= by.seconds * MICROS
            state = tick if ok else state
            out.append((ok,))
        elif isinstance(by, folds.RateLimit):
            if state is None or tick >= state[0] + by.width_s * MICROS:
                state = (tick, 0)
            state = (state[0], state[1] + 1)
            out.append((state[1] <= by.most,))
        elif isinstance(by, folds.SessionTouch):
            fresh = state is None or tick >= state[2]
            touch = fresh or tick - state[1] > by.idle_s * MICROS
            if touch:
                began = tick if fresh else state[0]
                state = (began, tick, min(tick + by.window_s * MICROS, began + by.cap_s * MICROS))
            out.append((state[0], touch, state[2]))
        else:
            count, last, until = state or (0, None, None)
            if until is not None and tick < until:
                out.append(("refused", count))
                continue
            if not failed:
                state = (0, None, None)
                out.append(("ok", 0))
                continue
            count = 1 if last is None or tick - last > by.window_s * MICROS else count + 1
            if count >= by.most:
                state = (0, tick, tick + by.lock_s * MICROS)
                out.append(("locked", 0))
            else:
                state = (count, tick, None)
                out.append(("failed", count))
    return out


FOLDS = [folds.Cooldown(60), folds.RateLimit(60, 3), folds.SessionTouch(30, 100, 250), folds.Lockout(3, 90, 40), folds.Lockout(2, 5, 200), folds.Lockout(1, 5, 20)]


@pytest.mark.parametrize("by", FOLDS, ids=str)
def test_runs_of_any_length_follow_the_rule(by):
    rng = random.Random(3)
    for _ in range(150):
        ticks = sorted(rng.randrange(900) * MICROS for _ in range(rng.randint(1, 60)))
        flags = [rng.random() < 0.8 for _ in ticks]
        got, state, at = [], None, 0
        while at < len(ticks):
            end = at + rng.randint(1, 9)
            state, cols = by.run(state, np.array(ticks[at:end]), np.array(flags[at:end]))
            got += list(zip(*(c.tolist() for c in cols.values()), strict=True))
            at = end
        assert got == loop(by, list(zip(ticks, flags, strict=True)))


@pytest.mark.parametrize("by", [folds.Lockout(3, 90, 40), folds.SessionTouch(30, 100, 250)], ids=str)
def test_batch_fold_over_keys(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), rng.randrange(4000) * MICROS, i, rng.random() < 0.8) for i in range(600)]
    df = spark.createDataFrame(rows, "user_id long, tick long, event_id long, failed boolean").repartition(5)
    got = {r[2]: tuple(r[3:]) for r in folds.fold(df, "user_id", by, flag="failed").collect()}
    for user in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in mine] == loop(by, [(r[1], r[3]) for r in mine])
    assert folds.fold(df.limit(0), "user_id", by, flag="failed").count() == 0


def test_stream_equals_the_batch_over_accepted_events(spark):
    """Three slices out of order, with a restart after each; late rows are counted and change nothing."""
    rng = random.Random(9)
    events = [(i, rng.choice([1, 2, 3, None]), START + timedelta(seconds=rng.randrange(3000)), rng.random() < 0.8) for i in range(400)]
    sliced = [[], [], []]
    for e in events:
        arrives = (e[2] - START).total_seconds() + (1200 if e[0] % 25 == 3 else rng.randrange(100))
        sliced[min(2, int(arrives // 1000))].append(e)
    by, late = folds.Lockout(3, 90, 40), 120
    frames = [spark.createDataFrame(s, "event_id long, user_id long, ts timestamp, failed boolean") for s in sliced]
    done = replay(spark, frames, lambda s: ordered_fold(s, "user_id", by, flag=F.col("failed"), late=f"{late} seconds"))
    accepted, passed, lost = [], None, 0
    for s in sliced:
        accepted += [e for e in s if passed is None or e[2] > passed]
        lost += sum(passed is not None and e[2] <= passed for e in s)
        newest = max(e[2] for e in s) - timedelta(seconds=late)
        passed = newest if passed is None else max(passed, newest)
    assert done.late == lost > 0
    got = {r.event_id: (r.outcome, r["count"]) for r in done.rows.collect()}
    want = {}
    for user in (1, 2, 3, None):
        mine = sorted((e for e in accepted if e[1] == user and e[2] <= passed), key=lambda e: (e[2], e[0]))
        want |= dict(zip([e[0] for e in mine], loop(by, [(int((e[2] - START).total_seconds()) * MICROS, e[3]) for e in mine]), strict=True))
    assert got == want and len(got) > 300


def test_an_event_in_time_joins_a_session_that_was_told_before(spark):
    at = lambda h: START + timedelta(hours=h)
    # after the first slice the watermark is at hour 10: both of user 1's sessions are told, then joined by an event of hour 9
    slices = [
        [(1, at(0)), (1, at(8)), (1, at(0.5)), (2, at(14)), (None, at(1))],
        [(1, at(9)), (1, at(7)), (2, at(20)), (None, at(2.5)), (3, at(8))],
        [(2, at(40)), (3, at(8))],
    ]
    frames = [spark.createDataFrame(s, "user_id long, ts timestamp") for s in slices]
    changes = replay(spark, frames, lambda s: session_changes(s, "user_id", "2 hours", late="4 hours")).rows
    got = {(r.user_id, (r.first - at(0).replace(tzinfo=None)).total_seconds() / 3600, r.n) for r in sessions_of(changes, "user_id").collect()}
    assert got == {(1, 0, 2), (1, 8, 2), (None, 1, 1), (2, 14, 1), (2, 20, 1)}
    assert changes.filter("sign < 0").count() == 1
