"""Late rows inside and outside the restatement window, and feed silence."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kpisleuth.streaming import silence, streams

SCHEMA = "feed string, ts timestamp, amount double"


def files(spark, folder, batches):
    for i, batch in enumerate(batches):
        frame = pd.DataFrame(batch, columns=["feed", "ts", "amount"])
        spark.createDataFrame(frame, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={i}")
    return [f"{folder}/in/part={i}" for i in range(len(batches))]


def T(day, hour=12):
    return dt.datetime(2025, 1, day, hour)


def stream(spark, paths):
    import shutil
    from pathlib import Path

    target = Path(paths[0]).parent.parent / "flat"
    target.mkdir()
    import os
    import time

    for i, p in enumerate(paths):
        for f in Path(p).glob("*.parquet"):
            to = target / f"{i:03d}.parquet"
            shutil.copy(f, to)
            stamp = time.time() - 1000 + i * 10
            os.utime(to, (stamp, stamp))
    return streams.read_stream(spark, str(target), SCHEMA, files_per_batch=1)


@pytest.mark.parametrize("late_day,kept", [(3, True), (1, False)])
def test_restatement_window(spark, tmp_path, late_day, kept):
    paths = files(spark, tmp_path, [
        [("pos", T(1), 1.0), ("pos", T(3), 1.0), ("pos", T(9), 1.0)],
        [("pos", T(9, 13), 1.0)],
        [("pos", T(late_day, 13), 10.0)],
        [("pos", T(25), 1.0)],
        [("pos", T(25, 13), 1.0)],
    ])
    daily = streams.stream_kpi(stream(spark, paths), ["feed"], "ts", "amount")
    got = {r["day"].day: r["total"] for r in streams.run_available(spark, daily, "late").collect()}
    assert got[late_day] == (11.0 if kept else 1.0)
    assert 25 not in got


def test_silence_is_alerted_once(spark, tmp_path):
    paths = files(spark, tmp_path, [
        [("pos", T(1, 0), 1.0), ("pos", T(1, 4), 1.0), ("pos", T(1, 20), 1.0), ("wms", T(1, 1), 1.0)],
        [("pos", T(2, 23), 1.0)],
    ])
    alerts = streams.stream_freshness(stream(spark, paths), "feed", "ts", 6)
    got = sorted((r["feed"], r["silent_since"], r["items"]) for r in streams.run_available(spark, alerts, "silent").collect())
    assert got == [("pos", T(1, 4), 2), ("pos", T(1, 20), 1), ("wms", T(1, 1), 1)]


HOUR = silence.MICROS_AN_HOUR


def brute_alerts(times, watermark, sla):
    """(silent since, alert) of every time of which nothing came for whole multiples of the SLA."""
    out, times = set(), sorted(times)
    for i, t in enumerate(times):
        following = times[i + 1] if i + 1 < len(times) else None
        at = t + sla
        while at <= watermark and (following is None or at < following):
            out.add((t, at))
            at += sla
    return out


@given(st.lists(st.integers(0, 60), min_size=1, max_size=25), st.integers(1, 8), st.integers(1, 12), st.randoms())
@settings(max_examples=300, deadline=None)
def test_silence_does_not_depend_on_batches(times, sla, lateness, draw):
    """Rows in any batches, late by no more than allowed, give the alerts of all rows at once."""
    order = sorted(times, key=lambda t: (t + draw.randint(0, lateness - 1), t))
    kept, told, got, top = [], 0, set(), 0
    while order:
        n = draw.randint(1, len(order))
        batch, order = order[:n], order[n:]
        kept = silence.joined(kept + [(t, t, 1) for t in batch], sla)
        top = max(top, *batch)
        alerts, kept, told, due = silence.settled(kept, told, top - lateness, sla)
        assert due > top - lateness
        assert not got & {a[:2] for a in alerts}
        got |= {a[:2] for a in alerts}
        assert all(a[3] == sum(t <= a[0] for t in times) for a in alerts)
    assert got == brute_alerts(times, top - lateness, sla)


class OneKey:
    """State and timers of one key, with the number of times its state was written."""

    def __init__(self):
        self.value, self.timers, self.writes = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark


def test_feeds_of_a_key_share_a_state_and_a_timer():
    """Many feeds cost one write a batch, and each has the alerts it would have alone, also before 1970."""
    draw, minute, n = random.Random(5), 60_000_000, 200
    key, work = OneKey(), silence.FeedSilence(6 * HOUR)
    work.init(key)
    times = {f: [-4000 * minute] for f in range(n)}
    work.handleInitialState((0,), pd.DataFrame({"feed": list(times), "at": [t[0] for t in times.values()]}), key)
    told = {f: [] for f in range(n)}
    for batch in range(4):
        rows = [(f, (-4000 + 1500 * batch + draw.randint(1, 1500)) * minute) for f in draw.sample(range(n), 120) for _ in range(draw.randint(1, 9))]
        for f, t in rows:
            times[f].append(t)
        frame = pd.DataFrame(rows, columns=["feed", "at"])
        list(work.handleInputRows((0,), iter([frame[:50], frame[50:]]), key))
        key.mark = (-4000 + 1500 * (batch + 1)) * 60_000
        assert key.writes == 2 * batch + 2 and len(key.timers) == 1
        fired = {t for t in key.timers if t <= key.mark}
        for out in (out for t in fired for out in work.handleExpiredTimer((0,), key, None)):
            for f, since, first, last, items in out[silence.SILENCES].itertuples(index=False):
                told[f] += [(since, since + k * 6 * HOUR) for k in range(first, last + 1)]
                assert items == sum(t <= since for t in times[f][1:])
        key.timers -= fired
    for f in range(n):
        assert len(told[f]) == len(set(told[f])) and set(told[f]) == brute_alerts(times[f], key.mark * 1000, 6 * HOUR)


def test_feeds_that_never_spoke_and_lasting_silence(spark, tmp_path):
    schema = "feed long, ts timestamp, amount double"
    for i, batch in enumerate([[(1, T(1, 0)), (1, T(1, 4)), (None, T(1, 5))], [(1, T(1, 12)), (3, T(1, 9)), (3, None)], [(1, T(2, 3))]]):
        folder = tmp_path / f"b{i}"
        spark.createDataFrame([(*r, 1.0) for r in batch], schema).coalesce(1).write.parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))
    registry = spark.createDataFrame([(1, T(1, 0)), (2, T(1, 2)), (None, T(1, 0)), (4, None)], "feed long, expected_from timestamp")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with streams.lent_settings(spark, silence.STATE_STORE):
        told = streams.run_available(spark, silence.feed_silence(source, registry, "feed", "ts", 6), "silence")
    assert spark.conf.get(key, None) == before
    got = sorted((r["feed"], r["silent_since"], r["alert_at"], r["repeat"], r["items"]) for r in told.collect())
    assert got == [
        (1, T(1, 4), T(1, 10), 1, 2), (1, T(1, 12), T(1, 18), 1, 3), (1, T(1, 12), T(2, 0), 2, 3),
        (2, T(1, 2), T(1, 8), 1, 0), (2, T(1, 2), T(1, 14), 2, 0), (2, T(1, 2), T(1, 20), 3, 0), (2, T(1, 2), T(2, 2), 4, 0),
        (3, T(1, 9), T(1, 15), 1, 1), (3, T(1, 9), T(1, 21), 2, 1)]
