"""Folds on streams: a key's events in event-time order, whatever order they arrive in.

Events wait in a key's state until the watermark has passed them; then none that could come before them is accepted any
more, and a timeout runs the key's fold over those that are due, in order. So the rows are those of the batch fold over the
accepted events, in append mode, and a restart from the checkpoint continues where the state stands. State is the fold's
few numbers and the events of the last ``late`` stretch; it goes once it makes no difference. Keys are dealt by hash to GROUPS
states of arrays, so a key costs no call of its own; a state holds 1 / GROUPS of the keys that wait.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Fold
from .events import with_event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, outside the heap."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: Keys share states by their hash: a call costs much the same for one key and for hundreds.
GROUPS = 1024


def _wake(state: GroupState, at: int) -> None:
    """Call again once the watermark has reached ``at`` (microseconds), which lies behind it."""
    state.setTimeoutTimestamp(-(-at // 1000) - 1)  # a timeout fires when it is less than the watermark


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    """Keys as text, and the number of the group whose state they share."""
    return rows.withColumn(key, F.col(key).cast("string")).withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)))


def _joined(known: list, raw: Iterable[bytes], kinds: tuple, names: tuple, key: str, frames: Iterable[pd.DataFrame]) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """All keys, then of the state's entries and the new rows together the place of each one's key and the columns."""
    keys, parts = list(known), [[np.frombuffer(bytes(x), kind)] for x, kind in zip(raw, (np.int32, *kinds), strict=True)]
    place = {k: i for i, k in enumerate(keys)}
    for pdf in frames:
        codes, found = pd.factorize(pdf[key].to_numpy(object), use_na_sentinel=False)
        at = [place.setdefault(None if k is None or k != k else k, len(place)) for k in found]
        parts[0].append(np.array(at, np.int32)[codes])
        for part, name in zip(parts[1:], names, strict=True):
            part.append(pdf[name].to_numpy(part[0].dtype))
    code, *columns = (np.concatenate(p) for p in parts)
    return list(place), code, columns


def _kept(keys: list, code: np.ndarray, stay: np.ndarray) -> tuple[list, np.ndarray]:
    """The keys that stay, and the entries' places among them."""
    return [k for k, s in zip(keys, stay.tolist(), strict=True) if s], (np.cumsum(stay) - 1)[code].astype(np.int32)


def _ordered(by: Fold, key: str) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The folds of a group's keys over new rows, or over those that became due."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, numbers, *raw = state.get if state.exists else ([], b"", b"", b"", b"", b"")
        held = {i: tuple(row) for i, row in enumerate(np.frombuffer(bytes(numbers), np.int64).reshape(-1, 1 + len(by.state)).tolist()) if row[0]}
        keys, code, (ticks, ties, flags) = _joined(known, raw, (np.int64, np.int64, bool), ("tick", "tie", "flag"), key, [] if state.hasTimedOut else frames)
        passed = state.getCurrentWatermarkMs() * 1000
        due = np.flatnonzero(ticks <= passed)
        due = due[np.lexsort((flags[due], ties[due], ticks[due], code[due]))]
        cuts = np.flatnonzero(np.r_[True, np.diff(code[due]) != 0]) if len(due) else []
        out = []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(due)].astype(int) if len(due) else [], strict=True):
            here, at = int(code[due[lo]]), due[lo:hi]
            after, values = by.run(held[here][1:] if here in held else None, ticks[at], flags[at])
            held[here] = (1, *(int(x) for x in after))
            out.append(values)
        if out:
            yield pd.DataFrame({key: np.array(keys, object)[code[due]], "tick": ticks[due], "tie": ties[due]} | {c: np.concatenate([v[c] for v in out]) for c in out[0]})
        rest = np.flatnonzero(ticks > passed)
        stay = np.zeros(len(keys), bool)
        stay[code[rest]] = True
        waits = ticks[rest].tolist()
        for here, row in held.items():
            if not stay[here] and (ends := by.ends(row[1:])) > passed:
                waits.append(ends)
                stay[here] = True
        if waits:
            left = np.array([held.get(i, (0,) * (1 + len(by.state))) for i in np.flatnonzero(stay).tolist()], np.int64)
            names, places = _kept(keys, code[rest], stay)
            state.update((names, left.tobytes(), *(x.tobytes() for x in (places, ticks[rest], ties[rest], flags[rest]))))
            _wake(state, int(min(waits)))
        elif state.exists:
            state.remove()

    return step


def ordered_fold(stream: DataFrame, key: str, by: Fold, tie: str = "event_id", flag: Column | None = None, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """key, tick (microseconds), tie and the fold's columns of every accepted event that the watermark has passed. tie: whole numbers;
    a null flag is false, a null time takes no part."""
    flag = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    rows = with_event_time(stream.filter(F.col(ts).isNotNull()), ts, late).select(F.col(key), ts, F.unix_micros(ts).alias("tick"), F.col(tie).cast("long").alias("tie"), flag.alias("flag"))
    held = "keys array<string>, held binary, codes binary, ticks binary, ties binary, flags binary"
    out = _grouped(rows, key).groupBy("_group").applyInPandasWithState(_ordered(by, key), f"{key} string, tick long, tie long, {by.out}", held, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(key, F.col(key).cast(stream.schema[key].dataType)).withColumnRenamed("tie", tie)


# ------------------------------------------------------------------ sessions that late events may still change


def _told(key: str) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, gap, *raw = state.get if state.exists else ([], 0, b"", b"", b"", b"", b"")
        frames = [] if state.hasTimedOut else [pdf.assign(n=1, told=False) for pdf in frames]
        for pdf in frames:
            gap = int(pdf["ends"].iloc[0] - pdf["tick"].iloc[0])
        keys, code, (first, last, n, told) = _joined(known, raw, (np.int64, np.int64, np.int64, bool), ("tick", "tick", "n", "told"), key, frames)
        passed = state.getCurrentWatermarkMs() * 1000
        order = np.lexsort((first, code))
        code, first, last, n, told = code[order], first[order], last[order], n[order], told[order]
        # stretches of a key that lie less than a gap apart become one; those told before and now part of a larger one are taken back
        upto = pd.Series(last).groupby(code).cummax().to_numpy()
        starts = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (first[1:] - upto[:-1] >= gap)])
        sizes = np.diff(np.r_[starts, len(first)])
        gone = told & (np.repeat(sizes, sizes) > 1)
        back = (code[gone], first[gone], n[gone])
        code, first, last, n, told = code[starts], first[starts], np.maximum.reduceat(last, starts), np.add.reduceat(n, starts), told[starts] & (sizes == 1)
        new = ~told & (last + gap <= passed)
        if len(back[0]) or new.any():
            whose, begin, count = (np.r_[b, x[new]] for b, x in zip(back, (code, first, n), strict=True))
            sign = np.where(np.arange(len(whose)) < len(back[0]), -1, 1)
            yield pd.DataFrame({key: np.array(keys, object)[whose], "first": begin, "n": count, "sign": sign})
        told = told | new
        waits = last + np.where(told, 2 * gap, gap)
        keep = waits > passed
        if keep.any():
            stay = np.zeros(len(keys), bool)
            stay[code[keep]] = True
            names, places = _kept(keys, code[keep], stay)
            state.update((names, gap, places.tobytes(), *(x[keep].tobytes() for x in (first, last, n, told))))
            _wake(state, int(waits[keep].min()))
        elif state.exists:
            state.remove()

    return step


def session_changes(stream: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """key, first (microseconds), n, sign: streaks of a key's events less than ``gap`` apart, told (1) when the watermark has reached their
    last event plus ``gap``, and taken back (-1) when an event that is not yet late changes one; :func:`sessions_of` nets them.

    An event is late when the watermark has reached it plus ``gap``. So one may still join a streak told before, for another
    ``gap``; only then the streak leaves the state.
    """
    rows = stream.filter(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.select(key, F.unix_micros(ts).alias("tick"), (F.col(ts) + F.expr(f"INTERVAL {gap}")).alias("until"))
    rows = rows.withColumn("ends", F.unix_micros("until")).withWatermark("until", f"{late} {gap}")  # the largest time less ``late``
    held = "keys array<string>, gap long, codes binary, first binary, last binary, n binary, told binary"
    out = _grouped(rows, key).groupBy("_group").applyInPandasWithState(_told(key), f"{key} string, first long, n long, sign long", held, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(key, F.col(key).cast(stream.schema[key].dataType))


def sessions_of(changes: DataFrame, key: str) -> DataFrame:
    """key, first (timestamp), n of the streaks that stand."""
    net = changes.groupBy(key, "first", "n").agg(F.sum("sign").alias("s")).filter("s > 0")
    return net.select(key, F.timestamp_micros("first").alias("first"), "n")
