"""Silent feeds, told by state and timers of event time.

A feed is silent when nothing has come for its SLA.  The alert is repeated for
every further SLA that the silence lasts, and a registered feed that has never
spoken is silent since the moment it was expected.

The state of a feed is its unsettled stretches: arrivals at most one SLA apart
are one stretch, as no alert can fall inside it, so the state is bounded by the
lateness allowed and not by the rows.  Alerts are given once the watermark has
passed them; they do not depend on how rows fall into batches.

A call of the state costs more than a feed's work, so ``FEEDS_A_KEY`` feeds of
neighbouring numbers share a key of the state and a timer, the earliest of theirs.
The alerts of one silence leave as one row, from the first to the last that is new.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MICROS_AN_HOUR = 3_600_000_000
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
FEEDS_A_KEY = 256
ROWS_AT_ONCE = 1 << 16
NEVER = -(1 << 62)
SILENCES = ["feed", "silent_since", "first_repeat", "last_repeat", "items"]


def joined(stretches: list[tuple[int, int, int]], sla: int) -> list[tuple[int, int, int]]:
    """Stretches (first, last, rows) in order of time, those at most ``sla`` apart as one."""
    out: list[tuple[int, int, int]] = []
    for first, last, items in sorted(stretches):
        if out and first - out[-1][1] <= sla:
            before = out.pop()
            first, last, items = before[0], max(before[1], last), before[2] + items
        out.append((first, last, items))
    return out


def told_runs(stretches: list[tuple[int, int, int]], told: int, watermark: int, sla: int):
    """Alerts up to the watermark as (silent since, first repeat, last repeat, items), the stretches still open,
    the last alert told and the next due time."""
    runs, seen = [], 0
    for at, (first, last, items) in enumerate(stretches):
        seen += items
        following = stretches[at + 1][0] if at + 1 < len(stretches) else None
        repeat = max(1, (told - last) // sla + 1)
        final = (watermark - last) // sla
        if following is not None:
            final = min(final, (following - last - 1) // sla)
        if final >= repeat:
            runs.append((last, repeat, final, seen))
            told, repeat = last + final * sla, final + 1
        if following is None or following > watermark:
            due = last + repeat * sla
            return runs, [(first, last, seen), *stretches[at + 1:]], told, due if following is None else min(due, following)


def settled(stretches: list[tuple[int, int, int]], told: int, watermark: int, sla: int):
    """The same with every alert by itself: silent since, alert, the how manieth, items."""
    runs, stretches, told, due = told_runs(stretches, told, watermark, sla)
    return [(last, last + k * sla, k, items) for last, a, b, items in runs for k in range(a, b + 1)], stretches, told, due


def arrived(feeds: np.ndarray, times: np.ndarray, count: int, sla: int) -> dict[int, list[tuple[int, int, int]]]:
    """Stretches of each feed among arrivals in any order, of which each counts as ``count`` rows."""
    order = np.lexsort((times, feeds))
    feeds, times = feeds[order], times[order]
    starts = np.flatnonzero(np.r_[True, (feeds[1:] != feeds[:-1]) | (times[1:] - times[:-1] > sla)])
    ends = np.r_[starts[1:], len(feeds)]
    out: dict[int, list[tuple[int, int, int]]] = {}
    for feed, first, last, rows in zip(*(x.tolist() for x in (feeds[starts], times[starts], times[ends - 1], ends - starts)), strict=True):
        out.setdefault(feed, []).append((first, last, rows * count))
    return out


class FeedSilence(StatefulProcessor):
    def __init__(self, sla: int):
        self.sla = sla

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feeds", "stretches binary, due bigint")

    def _kept(self) -> tuple[dict[int, tuple[list, int]], int | None]:
        """(stretches, last alert told) of each feed of the key, and the key's timer."""
        feeds: dict[int, tuple[list, int]] = {}
        if not self.state.exists():
            return feeds, None
        stretches, due = self.state.get()
        for feed, first, last, items, told in np.frombuffer(bytes(stretches), np.int64).reshape(-1, 5).tolist():
            feeds.setdefault(feed, ([], told))[0].append((first, last, items))
        return feeds, due

    def _keep(self, feeds: dict[int, tuple[list, int]], due: int, before: int | None) -> None:
        due = -(-due // 1000)  # timers count milliseconds
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        rows = [(feed, *s, told) for feed, (stretches, told) in feeds.items() for s in stretches]
        self.state.update((np.array(rows, np.int64).tobytes(), due))

    def _add(self, arrivals: Iterator[pd.DataFrame], count: int) -> None:
        feeds, before = self._kept()

        def add(frames: list[pd.DataFrame]) -> None:
            found = arrived(*(np.concatenate([f[c].to_numpy(np.int64) for f in frames]) for c in ("feed", "at")), count, self.sla)
            for feed, stretches in found.items():
                kept, told = feeds.get(feed, ([], NEVER))
                feeds[feed] = (joined(kept + stretches, self.sla), told)

        frames: list[pd.DataFrame] = []
        for frame in arrivals:
            frames.append(frame)
            if sum(map(len, frames)) >= ROWS_AT_ONCE:
                add(frames)
                frames = []
        if frames:
            add(frames)
        # Nothing is due before what was told.
        due = min(told_runs(stretches, told, told, self.sla)[3] for stretches, told in feeds.values())
        self._keep(feeds, due, before)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._add(iter([initialState]), 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._add(rows, 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        feeds, _ = self._kept()
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        out, dues = [], []
        for feed, (stretches, told) in feeds.items():
            runs, stretches, told, due = told_runs(stretches, told, watermark, self.sla)
            feeds[feed] = (stretches, told)
            out += [(feed, *run) for run in runs]
            dues.append(due)
        self._keep(feeds, min(dues), None)  # the timer that fired is gone
        if out:
            yield pd.DataFrame(np.array(out, np.int64), columns=SILENCES)

    def close(self) -> None:
        pass


def silences(stream: DataFrame, registry: DataFrame, feed: str, ts: str, sla_hours: int,
             lateness: str = "1 hour") -> DataFrame:
    """Silences of feeds: since when, the first and last alert of it that are new (``first_repeat``, ``last_repeat``,
    counted from 1), rows seen until then.  A silence that lasts over several batches has a row in each.

    ``registry`` has the columns ``feed`` and ``expected_from``.  Feeds that are not
    registered count from their first row.  Rows without feed or time are left out.
    The session needs ``STATE_STORE`` when the stream starts.
    """
    share = F.floor(F.col("feed") / FEEDS_A_KEY).alias("share")
    arrivals = stream.where(F.col(feed).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, lateness).select(
        F.col(feed).cast("long").alias("feed"), ts, F.unix_micros(ts).alias("at")).select(share, "feed", ts, "at")
    expected = registry.where("feed IS NOT NULL AND expected_from IS NOT NULL").select(
        F.col("feed").cast("long").alias("feed"), F.unix_micros("expected_from").alias("at")).select(share, "feed", "at")
    told = arrivals.groupBy("share").transformWithStateInPandas(
        FeedSilence(sla_hours * MICROS_AN_HOUR), ", ".join(f"{c} long" for c in SILENCES), "Append", "EventTime",
        initialState=expected.groupBy("share"))
    return told.select(
        F.col("feed").alias(feed), F.timestamp_micros("silent_since").alias("silent_since"), "first_repeat", "last_repeat", "items")


def feed_silence(stream: DataFrame, registry: DataFrame, feed: str, ts: str, sla_hours: int,
                 lateness: str = "1 hour") -> DataFrame:
    """Alerts of silent feeds, each by itself: since when, at what time, the how manieth, rows seen until then.

    See :func:`silences`.
    """
    alerts = silences(stream, registry, feed, ts, sla_hours, lateness).withColumn("repeat", F.explode(F.sequence("first_repeat", "last_repeat")))
    at = F.unix_micros("silent_since") + F.col("repeat") * (sla_hours * MICROS_AN_HOUR)
    return alerts.select(feed, "silent_since", F.timestamp_micros(at).alias("alert_at"), F.col("repeat").cast("int").alias("repeat"), "items")
