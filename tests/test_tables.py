"""Versioned layers and tables, dirty ranges, the index of briefs, parsers, and what an application asks for."""

import collections
import datetime as dt
import json
import os
import random
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewatch import api, storage, tables
from tidewatch.operators import brief, features, ingest, recompute, score, state
from tidewatch.plans import briefs, queries, recomputation, registry
from tidewatch.sources import market
from tidewatch.streaming import feeds

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_changed_input_gives_changed_layers(spark, tmp_path):
    sf = tmp_path / "sf"
    sf.mkdir()
    for name in ("lineitem", "supplier", "nation", "region"):
        shutil.copy(f"{SF}/{name}.parquet", sf / f"{name}.parquet")
    whole = queries.QUERIES["bars_daily"](spark, str(sf)).count()
    assert whole == queries.QUERIES["bars_daily"](spark, SF).count()
    pq.write_table(pq.read_table(f"{SF}/lineitem.parquet").slice(0, 500), sf / "lineitem.parquet")
    again = queries.QUERIES["bars_daily"](spark, str(sf))
    assert again.count() == market.bars(spark, str(sf)).count() < whole


def test_layer_is_written_once_and_lost_writers_leave_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    made = []

    def make():
        made.append(1)
        if len(made) == 1:
            raise RuntimeError("lost")
        return spark.read.parquet(source).withColumn("twice", F.col("id") * 2)

    with pytest.raises(RuntimeError):
        tables.layer(spark, "t-lost", [source], make)
    for _ in range(2):
        assert tables.layer(spark, "t-lost", [source], make, "id").count() == 10
    assert len(made) == 2
    spark.range(10, 15).write.mode("append").parquet(source)
    assert tables.layer(spark, "t-lost", [source], make, "id").count() == 15
    assert tables.retire(spark, "t-lost", [source]) >= 1
    assert tables.layer(spark, "t-lost", [source], make, "id").count() == 15 and len(made) == 3


def test_publish_is_exclusive(spark, tmp_path):
    target = f"file://{tmp_path}/x/0.json"
    assert tables.publish(spark, target, "one") and not tables.publish(spark, target, "two")
    assert tables.read_text(spark, target) == "one" and os.listdir(tmp_path / "x") == ["0.json"] or ".0.json.crc" in os.listdir(tmp_path / "x")


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, month int, v string")


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/t", "month")
    assert t.version() == -1 and t.read() is None
    t.upsert(frame(spark, [(i, i % 4, "a") for i in range(20)]), ["k"])
    before = t.manifest()["parts"]
    assert t.upsert(frame(spark, [(1, 1, "b"), (101, 1, "b")]), ["k"]) == 1
    after = t.manifest()["parts"]
    assert {k for k in before if before[k] != after[k]} == {"1"}
    want = {(i, i % 4, "a") for i in range(20)} - {(1, 1, "a")} | {(1, 1, "b"), (101, 1, "b")}
    assert rows_of(t.read()) == collections.Counter(want)
    assert rows_of(t.read(version=0)) == collections.Counter((i, i % 4, "a") for i in range(20))  # an older reader
    assert t.read([1, 3]).where("month not in (1, 3)").count() == 0
    t.replace(frame(spark, []), [2], lambda old: old.where("k > 10"))
    assert sorted(r.k for r in t.read([2]).collect()) == [14, 18]


def test_a_lost_or_beaten_writer(spark, tmp_path, monkeypatch):
    t = tables.Table(spark, f"file://{tmp_path}/t", "month")
    t.insert_absent(frame(spark, [(1, 1, "a")]), ["k"])
    real, beaten = tables.publish, []

    def late(spark_, target, text):
        if not beaten:  # another job publishes first
            beaten.append(1)
            tables.Table(spark, t.path, "month").insert_absent(frame(spark, [(2, 1, "other")]), ["k"])
        return real(spark_, target, text)

    monkeypatch.setattr(tables, "publish", late)
    t.insert_absent(frame(spark, [(2, 1, "mine"), (3, 1, "mine")]), ["k"])
    assert rows_of(t.read()) == {(1, 1, "a"): 1, (2, 1, "other"): 1, (3, 1, "mine"): 1}

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(tables, "publish", lost)
    with pytest.raises(RuntimeError):
        t.upsert(frame(spark, [(1, 1, "z")]), ["k"])
    assert (1, 1, "a") in rows_of(t.read())


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/t", "month")
    source = tmp_path / "in"
    frame(spark, [(i, i % 3, "a") for i in range(9)]).write.parquet(str(source))
    sink = feeds.into(t, ["k"], "s")

    def run(checkpoint, fail=False):
        def each(batch, number):
            sink(batch, number)
            if fail:
                raise RuntimeError("crash behind the write")

        stream = spark.readStream.schema("k long, month int, v string").parquet(str(source))
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        run(str(tmp_path / "c"), fail=True).awaitTermination()
    version = t.version()
    feeds.restarted(lambda: run(str(tmp_path / "c")), wait=0.1)
    assert t.version() == version and t.read().count() == 9  # the batch came again
    feeds.restarted(lambda: run(str(tmp_path / "c2")), wait=0.1)  # another job over the same rows
    assert t.read().count() == 9
    with pytest.raises(StreamingQueryException):
        feeds.restarted(lambda: run(str(tmp_path / f"c{random.random()}"), fail=True), tries=2, wait=0.01)


def test_dirty_ranges_read_and_write_their_partitions_only(spark):
    bars = registry.bars(spark, SF)
    calendar, known = market.earnings(bars), market.instruments(spark, SF)
    first, late = recomputation.split_late(bars)
    root = storage.work_dir(spark, "dirty")
    store = recompute.Store.at(spark, root)
    recompute.start(store, first, calendar)
    dirty = recompute.dirty_ranges(late, known)
    names = {r.symbol for r in dirty.collect()}
    assert names == {r.symbol for r in late.select("symbol").distinct().collect()}
    # a late bar of the market dirties every name
    assert recompute.dirty_ranges(late.limit(1).withColumn("symbol", F.lit("MARKET")), known).count() == known.count()
    parts = {str(r.part) for r in recompute.bucketed(dirty).collect()}
    proxies = recompute.bucketed(dirty.select(F.explode(F.array("proxy", F.lit("MARKET"))).alias("symbol")))
    for table, kept in ((store.features, parts), (store.events, parts), (store.days, parts), (store.bars, parts | {str(r.part) for r in proxies.collect()})):
        for part, folders in table.manifest()["parts"].items():
            if part not in kept:
                for folder in folders:
                    storage.remove(spark, folder)  # nobody may read it
    before = {n: t.manifest()["parts"] for n, t in vars(store).items()}
    recompute.apply(store, late, known, calendar, 0)
    version = store.events.version()
    recompute.apply(store, late, known, calendar, 0)  # a batch that comes again
    assert store.events.version() == version
    for n in ("features", "events", "days", "bars"):
        now = getattr(store, n).manifest()["parts"]
        assert {k for k in now if now[k] != before[n].get(k)} <= parts
    want = rows_of(registry.events(spark, SF).where(F.col("symbol").isin(*names)).select("fingerprint", F.round("score", 1), "headline"))
    got = rows_of(store.events.read(sorted(parts)).where(F.col("symbol").isin(*names)).select("fingerprint", F.round("score", 1), "headline"))
    assert got == want and sum(want.values()) > 50


def test_cut_series_needs_the_longest_frame(spark):
    with pytest.raises(ValueError):
        features.cut_features(registry.bars(spark, SF), 100, 100)


def test_indexed_briefs_equal_event_by_event(spark):
    rng = random.Random(8)
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=i) for i in range(30)]
    kinds = [("move_since_last_seen", "price"), ("volume_spike", "volume"), ("sector_divergence", "relative"), ("earnings_upcoming", "event"), ("quiet_regime", "volatility")]
    events = []
    for n in range(8):
        for i, day in enumerate(days):
            for position, (detector, family) in enumerate(kinds):
                if rng.random() < 0.15:
                    events.append((f"N{n}", "AB"[n % 2], day, position, detector, family, rng.choice([0.1, 0.5, 0.9]), rng.choice([0.5, 0.9, 1.0]), rng.random() < 0.9, rng.randint(0, 3), f"{n}-{i}-{position}", "k", "l", "h", 50.0))
    schema = "symbol string, sector string, bar_date date, position int, detector string, family string, strength double, confidence double, is_confirmed boolean, severity_rank int, fingerprint string, signal_key string, signal_label string, headline string, score double"
    events = spark.createDataFrame(events, schema)
    watch = [(u, f"N{n}", rng.choice(["NONE", "HEDGE"]), "NORMAL", rng.choice(days), rng.choice([None, 3])) for u in range(40) for n in rng.sample(range(9), 4)]
    watch = spark.createDataFrame(watch, "user_id long, symbol string, intent string, priority string, last_seen date, budget int")
    states = events.select("fingerprint").crossJoin(watch.select("user_id").distinct()).where("pmod(xxhash64(fingerprint, user_id), 11) = 0").withColumns({
        "status": F.expr("element_at(array('SEEN', 'SNOOZED', 'DISMISSED'), cast(1 + pmod(xxhash64(fingerprint), 3) as int))"), "until": F.lit("2024-04-02").cast("date"),
    })
    for known, now in ((states, "2024-04-01"), (states, "2024-04-05"), (states.limit(0), "2024-04-01")):
        at = F.lit(now).cast("date")
        plain = brief.items(brief.visible(events, watch, known, at))
        quick = brief.indexed_items(events, watch, known, at)
        columns = ["user_id", "symbol", "intent", "n_events", "score", "severity_rank", "budget", "sector", "has_catalyst"]
        assert rows_of(quick.select(*columns)) == rows_of(plain.select(*columns))
    index = brief.suffix_index(events)
    assert index.count() == events.where("severity_rank > 0").select("symbol", "bar_date").distinct().count()


def test_numbers_and_dates_of_providers(spark):
    value = {"open": "10", "high": " 12 ", "low": "9", "close": "1e1", "volume": "5"}
    bodies = [
        ("A", {"code": 0, "values": [{"datetime": "2024-06-03", **value}, {"datetime": "2024-6-4", **value}, {"datetime": "2024", **value}, {"datetime": "2024-06-05", **value, "close": "10d"}]}),
        ("B", {"code": 429, "values": [{"datetime": "2024-06-03", **value}]}), ("C", {"status": "error", "message": "no such name"}),
    ]
    raw = spark.createDataFrame([(s, "x", json.dumps(b)) for s, b in bodies], "symbol string, source_id string, body string")
    bars, letters = ingest.parse_values(raw)
    assert sorted((str(r.bar_date), r.high) for r in bars.collect()) == [("2024-06-03", 12.0), ("None", 12.0), ("None", 12.0)]
    assert {(r.symbol, r.reason) for r in letters.collect()} == {("B", "error code 429"), ("C", "no such name")}
    listed = [{"date": "2024-06-03T00:00:00Z", "open": "10", "high": 12, "low": "9.5", "close": "11", "volume": "100", "splitFactor": "1"}, {"date": "2024-06-04", "open": 5, "high": 6, "low": 4, "close": 5, "volume": "n/a", "splitFactor": 2}]
    bars, letters = ingest.parse_array(spark.createDataFrame([("A", "x", json.dumps(listed)), ("B", "x", '[{"date": "2024-06-03", "open": "high"}]')], "symbol string, source_id string, body string"))
    got = {str(r.bar_date): r for r in bars.collect()}
    assert (got["2024-06-03"].close, got["2024-06-03"].volume) == (5.5, 200.0) and got["2024-06-04"].volume != got["2024-06-04"].volume  # not a number
    assert [r.reason for r in letters.collect()] == ["no usable rows in response"]


def test_briefs_of_an_application(spark):
    watch = briefs.readers(spark, SF)
    user = watch.agg(F.min("user_id")).first()[0]
    got = api.brief(spark, SF, user)
    row = got["brief"].first()
    assert row.n_watched == watch.where(F.col("user_id") == user).count() == row.n_surfaced + row.n_normal + row.n_snoozed
    assert [i.symbol for i in (row["items"] or [])] == [r.symbol for r in got["items"].collect()]
    assert all(i.as_of <= dt.date(1998, 12, 31) and 0 < len(i.sparkline) <= 20 for i in (row["items"] or []))
    early = api.brief(spark, SF, user, "1998-12-20")["brief"].first()
    assert all(i.as_of <= dt.date(1998, 12, 20) for i in (early["items"] or []))
    nobody = api.brief(spark, SF, -5)["brief"].first()
    assert (nobody.rule, nobody.n_watched, nobody["items"]) == ("empty_watchlist", 0, None)


def test_replay_health_and_explanations(spark):
    out = api.replay(spark, SF, "1998-03-01", "1998-03-20").collect()
    sessions = registry.bars(spark, SF).where("kind = 'market' and bar_date between '1998-03-01' and '1998-03-20'").count()
    assert len(out) == sessions and [r.bar_date for r in out] == sorted(r.bar_date for r in out)
    assert all(len(r["items"] or []) == min(5, r.n_items) and r.quiet_count == 25 - r.n_items for r in out)
    one = api.replay(spark, SF, "1998-03-01", "1998-03-20", ["NATION_1"]).collect()
    assert all(r.quiet_count == 1 - r.n_items and {i.symbol for i in (r["items"] or [])} <= {"NATION_1"} for r in one)
    with pytest.raises(ValueError):
        api.replay(spark, SF, "1998-03-20", "1998-03-01")
    health = api.pipeline_health(spark, SF)
    assert health["ops_counts"].first().n_dead_letters > 0 and health["ops_last_runs"].count() == 8
    event = registry.events(spark, SF).join(briefs.readers(spark, SF).where("user_id = 1").select("symbol"), "symbol", "left_semi").first()
    told = api.explain_event(spark, SF, 1, event.fingerprint).first()
    assert told.headline == event.headline and told.positives
    assert api.explain_event(spark, SF, -1, event.fingerprint).count() == 0


def test_available_names_and_running_runs(spark):
    known = spark.createDataFrame([("A", True, False), ("B", True, False), ("F", True, True), ("X", False, False)], "symbol string, is_active boolean, is_fund boolean")
    watch = spark.createDataFrame([(1, "A"), (2, "B")], "user_id long, symbol string")
    assert [r.symbol for r in state.available(known, watch, 1).collect()] == ["B"]
    runs = ingest.begun(spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, started int"))
    ended = ingest.ended(runs, spark.createDataFrame([("A", "ok")], "symbol string, status string"), ["symbol"])
    assert {r.symbol: r.status for r in ended.collect()} == {"A": "ok", "B": "running"}


def test_debounced_stream(spark, tmp_path):
    at = dt.datetime(2024, 3, 1, 12)
    rows = [(i, at + dt.timedelta(seconds=s), u, "view", 1.0) for i, (u, s) in enumerate([(1, 0), (1, 2), (1, 4), (1, 60), (2, 0), (3, 4000)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "e"))
    out = feeds.drain(feeds.debounced(feeds.event_stream(spark, str(tmp_path / "e"))), "debounced_out", str(tmp_path / "c"))
    assert sorted((r.user_id, r.n) for r in out.collect()) == [(1, 1), (1, 3), (2, 1)]  # the last one is still open


def test_best_event_leads_without_points(spark):
    assert score.explained(F.array()) is not None
    text = f"file://{storage.work_dir(spark, 'report').removeprefix('file://')}/r.md"
    storage.write_text(spark, text, "# Title")
    assert tables.read_text(spark, text) == "# Title"


def test_keyed_state_does_not_depend_on_order(spark, tmp_path):
    from tidewatch.streaming import cursors

    rng = random.Random(3)
    past, future = dt.datetime(2024, 1, 1), dt.datetime(2090, 1, 1)
    rows = []
    for i in range(120):
        user, name, at = rng.randrange(4), f"N{rng.randrange(3)}", past + dt.timedelta(hours=i)
        rows.append((user, name, "seen", at, None, float(i)) if i % 3 else (user, name, "snooze", at, rng.choice([past, future]) + dt.timedelta(minutes=i), None))
    rows += rows[:20] + [(9, "N0", "seen", None, None, None), (9, "N0", "snooze", past, None, None)]
    schema = "user_id long, symbol string, kind string, at timestamp, until timestamp, snap_close double"
    whole = spark.createDataFrame(rows, schema)
    key = ["user_id", "symbol"]
    want = whole.groupBy(*key).agg(F.max(F.when(F.col("kind") == "seen", F.col("at"))).alias("last_seen"), F.max_by("snap_close", F.when(F.col("kind") == "seen", F.col("at"))).alias("snap_close"), F.max_by("until", F.when(F.col("kind") == "snooze", F.col("at"))).alias("until"))
    want = {(r.user_id, r.symbol): (r.last_seen, r.snap_close, r.until) for r in want.collect() if r.last_seen or r.until}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for order in (1, 2):
            random.Random(order).shuffle(rows)
            folder = tmp_path / f"a{order}"
            for part in range(3):
                spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(folder))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
            out = feeds.drain(cursors.reader_states(stream), f"readers{order}", str(tmp_path / f"c{order}"), "update").collect()
            found: dict = {}
            for r in out:  # each key's rows in the order of their batches
                found.setdefault((r.user_id, r.symbol), []).append((r.last_seen, r.snap_close, r.until, r.version))
            assert set(found) == set(want)
            for k, changes in found.items():
                assert want[k] in {c[:3] for c in changes} and max(c[3] for c in changes) <= len(rows)
                assert max((c[0] for c in changes if c[0]), default=None) == want[k][0]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_snoozes_wake_by_timers_in_any_order(spark, tmp_path):
    from tidewatch.streaming import cursors

    rng = random.Random(5)
    begin = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), f"N{rng.randrange(2)}", begin + dt.timedelta(minutes=30 * i), begin + dt.timedelta(minutes=30 * i + rng.choice([-5, 20, 90, 200, 700]))) for i in range(150)]
    rows += rows[:20] + [(1, "N0", rows[3][2], rows[3][2] + dt.timedelta(hours=2)), (1, "N0", None, begin), (1, None, begin, begin + dt.timedelta(hours=1)), (2, "N1", begin, None)]
    mark = max(r[2] for r in rows if r[2]) - dt.timedelta(days=1)
    want, asked = set(), {}
    for user, name, at, until in rows:
        if at and until and until > at:
            mine = asked.setdefault((user, name), {})
            mine[at] = max(until, mine.get(at, until))
    for (user, name), mine in asked.items():
        want |= {(user, name, at, until) for at, until in mine.items() if until < mark and not any(at < other <= until for other in mine)}
    schema = "user_id long, symbol string, at timestamp, until timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for order, parts in ((1, 1), (2, 4)):
            # rows come late by less than the delay, in several batches
            late = sorted(rows, key=lambda r: (r[2] or begin) + dt.timedelta(hours=random.Random(f"{order}{r}").randrange(20)))
            folder, size = tmp_path / f"w{order}", -(-len(rows) // parts)
            for part in range(parts):
                spark.createDataFrame(late[part * size : (part + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
            out = [tuple(r) for r in feeds.drain(cursors.woken(stream, "1 day"), f"woken{order}", str(tmp_path / f"k{order}")).collect()]
            assert len(out) == len(set(out)) and set(out) == want and len(want) > 20
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
