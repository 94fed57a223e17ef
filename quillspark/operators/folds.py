"""Folds: state that each event of a key changes in order, where the next state depends on what was accepted before.

Rows are dealt by key and sorted inside their partitions, and one pass keeps the state of a single key, so a key with
very many events streams through its task without being gathered. A :class:`Fold` takes a run of one key's events as
arrays and jumps from one change of state to the next; what lies between is filled in whole slices. The same folds run
on streams (``streaming.state``), where a key's state is a few numbers and ends by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000
Run = dict[str, np.ndarray]


@dataclass(frozen=True)
class Fold:
    """``run(state, ticks, flags) -> (state, columns)`` over ascending ticks (microseconds) and a flag for each event.

    State is None or a tuple of whole numbers, one for each name in ``state``; ``out`` is the schema of the columns.
    From ``ends(state)`` on, a state makes no difference.
    """

    out: ClassVar[str] = ""
    state: ClassVar[tuple[str, ...]] = ()

    def run(self, state: tuple | None, ticks: np.ndarray, flags: np.ndarray) -> tuple[tuple, Run]:
        raise NotImplementedError

    def ends(self, state: tuple) -> int:
        raise NotImplementedError


@dataclass(frozen=True)
class SessionTouch(Fold):
    """A session begins with its first request, is touched when idle for more than ``idle_s``, then expires ``window_s``
    later, never beyond ``cap_s`` after its begin; a request at its expiry or later begins a new one."""

    idle_s: int = 3600
    window_s: int = 7 * 86_400
    cap_s: int = 30 * 86_400
    out = "began long, touched boolean, expires long"
    state = ("began", "touched_at", "expires")

    def run(self, state, ticks, flags):
        began, touched, expires = (np.empty(len(ticks), t) for t in (np.int64, bool, np.int64))
        at = 0
        while at < len(ticks):
            # up to here the state as it is holds: the next touch, or the next session
            end = at if state is None else int(np.searchsorted(ticks, min(state[1] + self.idle_s * MICROS + 1, state[2])))
            end = max(end, at)
            if end > at:
                began[at:end], touched[at:end], expires[at:end] = state[0], False, state[2]
            if end < len(ticks):
                now = int(ticks[end])
                begin = now if state is None or now >= state[2] else state[0]
                state = (begin, now, min(now + self.window_s * MICROS, begin + self.cap_s * MICROS))
                began[end], touched[end], expires[end] = state[0], True, state[2]
            at = end + 1
        return state, {"began": began, "touched": touched, "expires": expires}

    def ends(self, state):
        return state[2]


@dataclass(frozen=True)
class Lockout(Fold):
    """Flags say which attempts failed. Failures at most ``window_s`` apart add up, the ``most``-th locks for ``lock_s`` and
    starts the count anew, a success clears it; while locked, attempts are refused and change nothing."""

    most: int = 10
    window_s: int = 900
    lock_s: int = 900
    out = "outcome string, count long"
    state = ("count", "last", "until")

    def run(self, state, ticks, flags):
        outcome, counts = np.empty(len(ticks), object), np.zeros(len(ticks), np.int64)
        count, last, until = state or (0, 0, 0)
        failed, at = flags.astype(bool), 0
        while at < len(ticks):
            end = max(at, int(np.searchsorted(ticks, until))) if until else at  # refused until the lock ends
            outcome[at:end], counts[at:end] = "refused", count
            if (at := end) == len(ticks):
                break
            until = 0
            bad, when = failed[at:], ticks[at:]
            before = np.r_[last if count else when[0] - self.window_s * MICROS - 1, when[:-1]]
            new = bad & np.r_[count == 0, ~bad[:-1]] | bad & (when - before > self.window_s * MICROS)
            place = np.arange(len(bad))
            first = np.maximum.accumulate(np.where(new | ~bad, place, -1))
            n = np.where(bad, np.where(first < 0, count + place + 1, place - first + 1), 0)
            full = np.flatnonzero(n >= self.most)
            stop = int(full[0]) + 1 if len(full) else len(bad)
            outcome[at : at + stop] = np.where(bad[:stop], "failed", "ok")
            counts[at : at + stop] = n[:stop]
            count, last = int(n[stop - 1]), int(when[stop - 1])
            if len(full):
                outcome[at + stop - 1], counts[at + stop - 1] = "locked", 0
                count, until = 0, last + self.lock_s * MICROS
            at += stop
        return (count, last, until), {"outcome": outcome, "count": counts}

    def ends(self, state):
        return max(state[2], state[1] + self.window_s * MICROS + 1 if state[0] else 0)


@dataclass(frozen=True)
class Cooldown(Fold):
    """Accepted when the last accepted one is at least ``seconds`` old."""

    seconds: int = 10
    out = "accepted boolean"
    state = ("accepted_at",)

    def run(self, state, ticks, flags):
        ok, at = np.zeros(len(ticks), bool), 0
        while True:
            if state is not None:
                at = max(at, int(np.searchsorted(ticks, state[0] + self.seconds * MICROS)))
            if at >= len(ticks):
                return state, {"accepted": ok}
            ok[at], state, at = True, (int(ticks[at]),), at + 1

    def ends(self, state):
        return state[0] + self.seconds * MICROS


@dataclass(frozen=True)
class RateLimit(Fold):
    """A window opens with a key's first hit and lasts ``width_s``; hits beyond ``most`` in it are refused."""

    width_s: int = 60
    most: int = 60
    out = "allowed boolean"
    state = ("opened", "hits")

    def run(self, state, ticks, flags):
        allowed, at = np.zeros(len(ticks), bool), 0
        opened, hits = state or (None, 0)
        while at < len(ticks):
            if opened is None or ticks[at] >= opened + self.width_s * MICROS:
                opened, hits = int(ticks[at]), 0
            end = int(np.searchsorted(ticks, opened + self.width_s * MICROS))
            allowed[at:end] = hits + 1 + np.arange(end - at) <= self.most
            hits, at = hits + end - at, end
        return (opened, hits), {"allowed": allowed}

    def ends(self, state):
        return state[0] + self.width_s * MICROS


def fold(events: DataFrame, key: str, by: Fold, tick: str = "tick", tie: str = "event_id", flag: str | None = None) -> DataFrame:
    """key, tick, tie and the fold's columns for every row; rows of a key go in order of (tick, tie). Null keys are one key."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, tick, tie)}
    rows = events.select(F.col(key).cast("string").alias(key), tick, tie, (F.col(flag) if flag else F.lit(False)).alias("flag"))
    rows = rows.repartition(key).sortWithinPartitions(key, tick, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for pdf in batches:
            if not len(pdf):
                continue
            ticks, flags = pdf[tick].to_numpy(np.int64), pdf["flag"].to_numpy(bool)
            codes = pd.factorize(pdf[key])[0]
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            parts = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = pdf[key].iloc[lo] if codes[lo] >= 0 else None
                if now != at:
                    at, state = now, None
                state, values = by.run(state, ticks[lo:hi], flags[lo:hi])
                parts.append(values)
            out = {key: pdf[key], tick: ticks, tie: pdf[tie].to_numpy()}
            yield pd.DataFrame(out | {c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    schema = ", ".join([f"{key} string", f"{tick} {kinds[tick]}", f"{tie} {kinds[tie]}", by.out])
    return rows.mapInPandas(run, schema).withColumn(key, F.col(key).cast(kinds[key]))
