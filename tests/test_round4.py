"""Findings of round 4: readers who see the same share their items, a driver collects behind each layer, a histogram from shared items, snoozes that wake by buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import tables
from tidewatch.operators import brief
from tidewatch.streaming import cursors, feeds

NOW = dt.date(2024, 3, 1)


@pytest.fixture(scope="module")
def read(spark):
    """Made-up events, readers and read states; two readers in three see the same as another one."""
    rng = random.Random(4)
    kinds = [("move_since_last_seen", "price", "move_z"), ("volume_spike", "volume", "rvol"), ("earnings_upcoming", "event", "earnings_proximity"), ("quiet_regime", "volatility", "quiet_regime")]
    events = []
    for n in range(6):
        for d in range(30):
            for position, (detector, family, key) in enumerate(kinds):
                if rng.random() < 0.3:
                    strength = rng.choice([0.0, 0.2, 0.5, 0.5, 0.9])
                    events.append((f"N{n}", "S", NOW - dt.timedelta(days=d), position, detector, family, strength, key, f"label {rng.randrange(2)}", f"headline {n} {d} {position}", rng.choice([30.0, 30.0, 55.5]), rng.randrange(3), rng.choice([0.5, 1.0]), rng.random() < 0.8, f"f{n}.{d}.{position}"))
    schema = "symbol string, sector string, bar_date date, position int, detector string, family string, strength double, signal_key string, signal_label string, headline string, score double, severity_rank int, confidence double, is_confirmed boolean, fingerprint string"
    watch, states = [], []
    for u in range(60):
        like = random.Random(u % 20)
        for n in range(6):
            if like.random() < 0.7:
                watch.append((u, f"N{n}", like.choice(["HOLDING", "NONE"]), like.choice(["HIGH", "LOW"]), NOW - dt.timedelta(days=like.randrange(1, 25)), like.choice([None, 2])))
        for e in events:
            if like.random() < (1.0 if u % 20 == 3 else 0.5):
                status = "SNOOZED" if u % 20 == 3 else like.choice(["SEEN", "SNOOZED", "DISMISSED"])
                states.append((u, e[-1], status, NOW + dt.timedelta(days=2 if u % 20 == 3 else like.choice([-1, 2])) if status == "SNOOZED" else None))
    return (
        spark.createDataFrame(events, schema), spark.createDataFrame(watch, "user_id long, symbol string, intent string, priority string, last_seen date, budget int"),
        spark.createDataFrame(states, "user_id long, fingerprint string, status string, until date"),
    )


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_items_of_readers_who_see_the_same_are_made_once(read):
    events, watch, states = read
    at = F.lit(NOW)
    found = brief.pairs(events, watch, states, at).cache()
    shared = brief.case_items(found, brief.reachable(events, watch)).cache()
    want = brief.items(brief.visible(events, watch, states, at), explain=True)
    columns = ["user_id", "symbol", "intent", "priority", "budget", "n_events", "is_confirmed", "sector", "score", "severity", "attention", "positives", "suppressors", "lead"]
    got = found.join(shared, brief.CASE)
    assert rows(got, *columns) == rows(want, *columns) and want.count() > 100
    assert shared.count() * 3 == got.count()  # before, each reader's events were scored again
    wide = {"headline", "fingerprint", "signal_label"} & set(found.columns)
    assert not wide and found.count() == watch.count()


def test_lead_is_the_best_event_of_the_strongest_signal(read):
    events, watch, states = read
    shown = brief.visible(events, watch, states, F.lit(NOW)).collect()
    out = brief.items(brief.visible(events, watch, states, F.lit(NOW)), explain=True).collect()
    order = lambda e: (e.score, e.bar_date, -e.position)
    for item in out:
        mine = [e for e in shown if (e.user_id, e.symbol) == (item.user_id, item.symbol)]
        top = next((p for p in item.positives if p.kind == "additive"), None)
        owned = [e for e in mine if top and (e.signal_key, e.signal_label) == (top.key, top.label)]
        assert item.lead.fingerprint == max(owned or mine, key=order).fingerprint


def test_a_written_layer_lets_the_driver_collect(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    calls, forget = [], tables.forget
    monkeypatch.setattr(tables, "forget", lambda s: (calls.append(1), forget(s)))
    for _ in range(2):
        out = tables.layer(spark, f"left-{tmp_path.name}", [str(tmp_path / "t")], lambda: spark.range(100_000).groupBy(F.col("id") % 1000).count())
        assert out.count() == 1000
    assert len(calls) == 1  # once behind the plan that was run, not where a layer is there already


def test_histogram_from_shared_items(read):
    events, watch, states = read
    at = F.lit(NOW)
    found = brief.pairs(events, watch, states, at).cache()
    shared = brief.case_items(found, brief.reachable(events, watch)).cache()
    shown = brief.visible(events, watch, states, at)
    asleep = brief.snoozed_names(brief.past_cursor(events, watch), shown, states, at)
    columns = ["user_id", "severity", "n"]
    assert rows(brief.counted(found, shared), *columns) == rows(brief.histogram(watch, brief.items(shown), asleep), *columns)
    assert rows(brief.silenced_pairs(found, shared), "user_id", "symbol") == rows(asleep, "user_id", "symbol") and asleep.count() > 5
    links = events.where("position = 1").select("symbol", "bar_date").distinct()
    assert rows(brief.themed_days(found, brief.reachable(events, watch), links), "user_id", "symbol", "bar_date") == rows(shown.join(links, ["symbol", "bar_date"]).select("user_id", "symbol", "bar_date").distinct(), "user_id", "symbol", "bar_date")


@pytest.mark.parametrize("buckets", [1, 7])
def test_snoozes_wake_with_few_calls_into_python(spark, tmp_path, buckets):
    rng, begin, hour = random.Random(6), dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    rows = [(rng.choice([None, 1, 2**60 + 1, 2**60 + 2]), rng.choice([None, "A", "B"]), begin + rng.randrange(400) * hour / 2, None) for _ in range(500)]
    rows = [(u, n, at, at + rng.choice([-1, 0.25, 3, 3, 30]) * hour) for u, n, at, _ in rows]
    rows += [(u, n, at, until + hour / 3) for u, n, at, until in rows[:100]] + rows[:50] + [(1, "A", None, begin), (1, "A", begin, None), (1, "A", begin + 900 * hour, None)]
    mark, asked = begin + 900 * hour - 24 * hour, {}  # the clock runs with every row that has a time
    for u, n, at, until in rows:
        if at and until and until > at:
            mine = asked.setdefault((u, n), {})
            mine[at] = max(until, mine.get(at, until))
    want = {(u, n, at, until) for (u, n), mine in asked.items() for at, until in mine.items() if until < mark and not any(at < other <= until for other in mine)}
    spark.createDataFrame(rows, "user_id long, symbol string, at timestamp, until timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, symbol string, at timestamp, until timestamp").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        out = [tuple(r) for r in feeds.drain(cursors.woken(stream, "1 day", buckets), f"bucketed{buckets}", str(tmp_path / "k")).collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert len(out) == len(set(out)) and set(out) == want and len(want) > 100
