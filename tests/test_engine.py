"""Engine tests: oracle comparisons on the smallest tables, and fire / must-not-fire pairs on seeded series."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import brief, detect, features, ingest, narrative, score, state, themes
from tidewatch.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", [
    "bars_daily", "feat_beta_sector", "feat_move_sigmas", "feat_rv10_pct", "stats_pairwise_correlation", "detect_all", "detect_headlines", "score_days", "score_contributions", "score_aged", "themes_multi_day", "theme_events",
    "ingest_reconcile", "ingest_conflicts", "ingest_split_adjust", "ingest_validate", "ingest_validate_pieces", "state_woken", "ingest_parse_array", "ingest_runs", "ingest_insert_if_absent", "window_stats", "brief_explained", "brief_histogram", "brief_narrative",
    "detect_since_cursor", "state_mark_seen", "state_snooze", "state_watchlist", "ops_sources", "debounce_sessions",
])
def test_query_matches_sql(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    got = plain(tuple(r) for r in mine.select(*columns).collect())
    assert got == plain(theirs.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def series(spark, days=260, seed=42, vol=0.012, last_move=None, volume_times=1.0):
    """Bars of one instrument with its sector and the market; the last bar can be made to jump."""
    rng = random.Random(seed)
    rows, price, index = [], 100.0, 100.0
    day = dt.date(2024, 1, 1)
    for i in range(days):
        prev = price
        price *= math.exp(rng.gauss(0, vol) if last_move is None or i < days - 1 else last_move * vol)
        index *= math.exp(rng.gauss(0, vol / 3))
        volume = int(1e6 * math.exp(rng.gauss(0, 0.25)) * (volume_times if i == days - 1 else 1))
        rows.append(("X", "instrument", "S", day, prev, max(prev, price), min(prev, price), price, price, volume, 1.0, True))
        for symbol, kind, sector in (("SEC:S", "sector", "S"), ("MARKET", "market", None)):
            rows.append((symbol, kind, sector, day, index, index, index, index, index, 1, 1.0, True))
        day += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "symbol string, kind string, sector string, bar_date date, open double, high double, low double, close double, close_adj double, volume long, confidence double, confirmed boolean")


NO_REPORTS = "symbol string, report_date date, session string"


def fired_last(bars, calendar=(), sessions=None):
    rows = features.features(bars)
    if sessions:
        rows = features.moved(rows, F.lit(sessions))
    rows = detect.with_earnings(detect.with_samples(rows), bars.sparkSession.createDataFrame(list(calendar), NO_REPORTS))
    cands = detect.candidates(features.ready(rows))
    last = bars.agg(F.max("bar_date")).first()[0]
    return {r.detector: r for r in cands.where(F.col("bar_date") == F.lit(last)).collect()}


def test_jump_fires_and_calm_does_not(spark):
    assert {"move_since_last_seen", "sector_divergence"} <= set(fired_last(series(spark, last_move=6)))
    assert not {"move_since_last_seen", "sector_divergence", "range_break"} & set(fired_last(series(spark, last_move=0.1)))


def test_volume_spike_pair(spark):
    assert "volume_spike" in fired_last(series(spark, volume_times=6, last_move=0.1))
    assert "volume_spike" not in fired_last(series(spark, last_move=0.1))


def test_drift_fires_over_its_horizon_only(spark):
    rng = random.Random(3)
    bars, price, day = [], 100.0, dt.date(2024, 1, 1)
    for i in range(200):
        prev = price
        price *= math.exp(rng.gauss(0, 0.01) - (0.012 if i >= 190 else 0))
        bars.append(("X", "instrument", "S", day + dt.timedelta(days=i), prev, max(prev, price), min(prev, price), price, price, 1000, 1.0, True))
    df = spark.createDataFrame(bars, series(spark, 2).schema)
    assert "move_since_last_seen" not in fired_last(df)
    found = fired_last(df, sessions=10)["move_since_last_seen"]
    assert found.direction == -1 and found.sessions_used == 10 and "in 10 sessions" in found.headline


def test_earnings_ahead(spark):
    bars = series(spark, days=90, last_move=0.1)
    last = bars.agg(F.max("bar_date")).first()[0]
    near = fired_last(bars, [("X", last + dt.timedelta(days=1), "bmo"), ("X", last + dt.timedelta(days=30), "amc"), ("Y", last, "amc")])["earnings_upcoming"]
    assert (near.signal_value, near.headline) == (21.5, "Report due in 1 d, premarket")
    assert "earnings_upcoming" not in fired_last(bars, [("X", last + dt.timedelta(days=3), "amc"), ("X", last - dt.timedelta(days=1), "amc"), ("X", None, "amc")])
    # a report of the same morning is past, and is the next one all the same
    assert "earnings_upcoming" not in fired_last(bars, [("X", last, "bmo"), ("X", last + dt.timedelta(days=1), "bmo")])


def test_features_do_not_look_ahead(spark):
    bars = series(spark, days=140)
    cut = dt.date(2024, 1, 1) + dt.timedelta(days=110)
    columns = ["bar_date", "sigma20", "rv60", "atr14", "beta_market", "corr20", "rvol"]
    whole = features.features(bars).where(F.col("bar_date") <= F.lit(cut)).select(*columns)
    short = features.features(bars.where(F.col("bar_date") <= F.lit(cut))).select(*columns)
    assert plain(map(tuple, whole.collect())) == plain(map(tuple, short.collect()))
    assert whole.where("beta_market is not null").count() > 50


def test_score_ladder(spark):
    schema = "s_event double, s_relative double, s_price double, s_volume double, s_volatility double, has_catalyst boolean, idiosyncratic boolean, confidence double, is_confirmed boolean"
    rows = spark.createDataFrame([
        (None, None, 0.9, None, None, False, False, 1.0, True),
        (0.9, 0.9, 0.9, 0.9, 0.9, False, False, 1.0, True),
        (0.9, 0.9, 0.9, 0.9, 0.9, False, False, 1.0, False),
        (None, None, None, None, None, False, False, 1.0, True),
    ], schema)
    out = [(r.score, r.severity_rank) for r in score.scored(rows).collect()]
    # 90 points times 0.22 ** 0.25, rounded to two places first
    assert out == [(61.2, 2), (90.0, 4), (76.5, 3), (0.0, 0)]


def test_recency(spark):
    row = spark.range(1).select(
        score.recency(F.lit("volume_spike"), F.lit(2)).alias("a"), score.recency(F.lit("volume_spike"), F.lit(50)).alias("b"), score.recency(F.lit("earnings_upcoming"), F.lit(9)).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == (0.5, 0.35, 1.0)


def test_validation_ignores_rejected_closes(spark):
    d = dt.date(2024, 6, 3)
    rows = [("X", "a", d + dt.timedelta(days=i), c, c, c, c, c, 1.0) for i, c in [(0, 100.0), (1, 10.0), (2, 101.0), (2, 102.0), (40, 300.0), (41, -1.0)]]
    bars = spark.createDataFrame(rows, "symbol string, source_id string, bar_date date, open double, high double, low double, close double, close_adj double, volume double")
    out = ingest.validated(bars, F.lit("2030-01-01").cast("date")).orderBy("bar_date", "close").collect()
    assert [r.problem for r in out] == [None, "implausible move", None, "duplicate date", None, "open is not positive"]


def test_validation_in_pieces_equals_the_fold(spark):
    rng = random.Random(11)
    first, rows = dt.date(2023, 12, 20), []
    for name in ("X", "Y", "Z"):
        for _ in range(160):  # repeated dates, leaps, rows without a date, and gaps of all lengths
            c = rng.choice([100.0, 101.0, 10.0, 170.0, 300.0, -1.0, float("nan")])
            day = None if rng.random() < 0.03 else first + dt.timedelta(days=rng.randrange(70) if name == "X" else rng.randrange(70) * 3)
            rows.append((name, rng.choice("ab"), day, c, c, c, c, c, 1.0))
    rows += rows[:15] + [("W", "a", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    schema = "symbol string, source_id string, bar_date date, open double, high double, low double, close double, close_adj double, volume double"
    bars, today = spark.createDataFrame(rows, schema), F.lit("2030-01-01").cast("date")
    want = sorted(map(repr, ingest.validated(bars, today).collect()))
    assert {"implausible move", "duplicate date", "malformed date"} <= {r.problem for r in ingest.validated(bars, today).collect()}
    for days in (4, 5, 30, 366):
        assert sorted(map(repr, ingest.validated_in_pieces(bars, today, days).collect())) == want, days
    assert ingest.validated_in_pieces(bars.limit(0), today).count() == 0
    with pytest.raises(ValueError):
        ingest.validated_in_pieces(bars, today, 3)


def test_payloads(spark):
    good = '{"values": [{"datetime": "2024-06-04", "open": "1", "high": "2", "low": "1", "close": "2", "volume": "x"}, {"datetime": "2024-06-03", "open": "1", "high": "2", "low": "1", "close": "3", "volume": "5"}, {"datetime": "2024-06-05", "open": "n/a", "high": "2", "low": "1", "close": "2", "volume": "5"}]}'
    bodies = [good, '{"status": "error", "message": "quota"}', '{"code": 500}', '{"values": []}', '{"values": [{"datetime": "2024-06-05", "open": "n/a"}]}', "oops", None]
    raw = spark.createDataFrame([(f"S{i}", "a", b) for i, b in enumerate(bodies)], "symbol string, source_id string, body string")
    bars, letters = ingest.parse_values(raw)
    assert [(r.symbol, str(r.bar_date), r.close, r.close_adj, r.volume) for r in bars.collect()] == [("S0", "2024-06-03", 3.0, 3.0, 5.0), ("S0", "2024-06-04", 2.0, 2.0, 0.0)]
    reasons = {r.symbol: r.reason for r in letters.collect()}
    assert reasons == {"S1": "quota", "S2": "error code 500", "S3": "no values in response", "S4": "no usable rows in response", "S5": reasons["S5"], "S6": "not a JSON object"} and reasons["S5"]


def test_split_payloads(spark):
    rows = '[{"date": "2024-06-10T00:00:00Z", "open": 50, "high": 50, "low": 50, "close": 50, "volume": 1e7, "splitFactor": 10}, {"date": "2024-06-07", "open": 500, "high": 500, "low": 500, "close": 500, "volume": 1000000.4, "splitFactor": 1}, {"date": "2024-06-06", "open": null, "close": 1}]'
    raw = spark.createDataFrame([("S0", "b", rows), ("S1", "b", '{"detail": "no"}'), ("S2", "b", "[]")], "symbol string, source_id string, body string")
    bars, letters = ingest.parse_array(raw)
    assert [(str(r.bar_date), r.close, r.close_adj, r.volume) for r in bars.orderBy("bar_date").collect()] == [("2024-06-07", 50.0, 50.0, 10000004.0), ("2024-06-10", 50.0, 50.0, 10000000.0)]
    assert {r.symbol: r.reason for r in letters.collect()} == {"S1": "expected an array of prices", "S2": "no rows in response"}


def test_live_feed_and_fixtures(spark, tmp_path):
    """A feed over a URL (here files) with a symbol that fails at every try; then both sources through the whole ingestion."""
    from tidewatch.sources import providers

    for symbol, close in (("A", 101), ("B", 50)):
        body = ", ".join(f'{{"datetime": "2024-06-0{d}", "open": "{close}", "high": "{close}", "low": "{close}", "close": "{close}", "volume": "10"}}' for d in (3, 4, 5))
        (tmp_path / f"{symbol}.json").write_text(f'{{"values": [{body}]}}')
    live = providers.HttpSource("alpha", 1, f"file://{tmp_path}/{{symbol}}.json", "values", tries=2, wait=0.01)
    bars, letters = live.daily_bars(spark, ["A", "B", "C"], "2024-06-04", "2024-06-05")
    assert sorted((r.symbol, str(r.bar_date)) for r in bars.collect()) == [(s, f"2024-06-0{d}") for s in "AB" for d in (4, 5)]
    assert [(r.symbol, r.source_id) for r in letters.collect()] == [("C", "alpha")]
    second = bars.where("symbol = 'A'").withColumns({"source_id": F.lit("beta"), "trust_rank": F.lit(2), "close": F.lit(90.0), "low": F.lit(90.0)})
    providers.write_fixtures(second, str(tmp_path / "fixtures"))
    files = providers.FixtureSource("beta", 2, str(tmp_path / "fixtures"))
    out = providers.gather(spark, [live, files], ["A", "B", "C"], "2024-06-10", "2024-06-04", "2024-06-05")
    assert {r.symbol: r.status for r in out["runs"].collect()} == {"A": "ok", "B": "partial", "C": "failed"}
    assert {(r.symbol, r.source_id, r.confirmed) for r in out["bars"].collect()} == {("A", "alpha", False), ("B", "alpha", True)}
    assert {r.field for r in out["conflicts"].collect()} == {"low", "close"}
    assert {r.symbol for r in out["dead_letters"].collect()} == {"C"}


def test_cursors_only_move_forward(spark):
    cursors = spark.createDataFrame([(1, "X", dt.date(2024, 1, 10), 3)], "user_id long, symbol string, last_seen date, version int")
    seen = spark.createDataFrame([(1, "X", dt.date(2024, 1, 5))], "user_id long, symbol string, seen_at date")
    row = state.mark_seen(cursors, seen).first()
    assert (row.last_seen, row.version) == (dt.date(2024, 1, 10), 3)


def test_narrative_order(spark):
    def rule(*values):
        return spark.range(1).select(narrative.rule(*[F.lit(v) for v in values]).alias("r")).first().r

    assert rule(3, 1, 1, 0, 1, 0.0, 0.0, 0.0, 5) == "sector_rotation"
    assert rule(3, 1, 0, 3, 1, 0.1, 0.01, 0.0, 5) == "sector_specific"
    assert rule(3, 1, 0, 3, 1, 0.9, 0.01, 0.0, 5) == "theme_led_market"
    assert rule(0, 1, 1, 0, 1, 0.0, 0.0, 0.0, 5) == "quiet"
    assert rule(0, 0, 0, 0, None, 0.0, 0.0, 0.0, 0) == "empty_watchlist"


def test_stream_once_and_cursors(spark, tmp_path):
    from tidewatch.streaming import feeds

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3, "view", 1.0) for i in range(30)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for _ in range(2):  # the same events twice
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.event_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    assert feeds.drain(feeds.once(stream), "once_out", str(tmp_path / "c1")).count() == 30
    moved = feeds.drain(feeds.cursor_updates(stream), "cursor_out", str(tmp_path / "c2"), "update")
    last = moved.groupBy("user_id").agg(F.max("last_seen").alias("at"), F.max("n_events").alias("n")).collect()
    assert sorted((r.user_id, r.at.hour, r.n) for r in last) == [(0, 3, 20), (1, 4, 20), (2, 5, 20)]
    prints = feeds.event_stream(spark, str(tmp_path / "in")).withColumn("fingerprint", F.concat_ws("|", "user_id", "event_type"))
    assert feeds.drain(feeds.once(prints, "fingerprint"), "print_out", str(tmp_path / "c3")).count() == 3


def accounting_tables():
    """Readers of ten names in two sectors, with themes, a moving market and events of every kind."""
    rng = random.Random(7)
    now = dt.date(2024, 3, 31)
    names = [(f"N{i}", "AB"[i % 2]) for i in range(10)]
    days = [now - dt.timedelta(days=k) for k in range(59, -1, -1)]
    bars = []
    for symbol, kind in [*((s, "instrument") for s, _ in names), ("MARKET", "market")]:
        price = 100.0
        for i, day in enumerate(days):
            # the market climbs until a week before the end and falls from then on
            price *= math.exp(rng.gauss(0, 0.01) + (0.006 if i < 53 else -0.02) * (1 if kind == "market" else rng.choice([-1, 1.5])))
            bars.append((symbol, kind, day, round(price, 4)))
    recent = [now - dt.timedelta(days=k) for k in (1, 4, 9)]
    themes = [(recent[0], "A", 1, 70.0), (recent[1], "A", -1, 60.0), (recent[1], "B", -1, 80.0), (recent[2], "B", 1, 80.0)]
    links = [(s, day, sector, way, c) for day, sector, way, c in themes for s, x in names if x == sector and rng.random() < 0.8]
    watch, shown = [], []
    for user in range(400):
        since = rng.choice([2, 5, 8, 12, 25, 40])
        mine = rng.sample(names, rng.choice([3, 5, 7]))
        if user % 4 == 0:
            mine = [n for n in names if n[1] == "AB"[user % 8 // 4]]
        for symbol, sector in mine:
            watch.append((user, symbol, now - dt.timedelta(days=since + rng.randrange(3))))
            for day in [*recent, now] if user % 3 else [now, recent[user % 2]]:
                if rng.random() < 0.45:
                    shown.append((user, symbol, sector, "NONE", "NORMAL", "range_break", "price", rng.choice([0.2, 0.99]), day))
    return watch, shown, links, bars


def test_accounting_tells_every_story(spark):
    """Every rule of the narrative comes out, the same as from SQL; with a budget of 2 no three items can be shown."""
    from tidewatch.plans.briefs import ACCOUNTING, TEXT, facts_sql

    watch, shown, links, bars = accounting_tables()
    context = {"confidence": 1.0, "is_confirmed": True, "score": 50.0, "position": 3, "resid_market": 0.0, "resid_std_market": 1.0}
    events = spark.createDataFrame(shown, "user_id long, symbol string, sector string, intent string, priority string, detector string, family string, strength double, bar_date date")
    tables = {
        "readers": spark.createDataFrame(watch, "user_id long, symbol string, last_seen date"),
        "shown": events.withColumns({k: F.lit(v) for k, v in context.items()}),
        "links": spark.createDataFrame(links, "symbol string, bar_date date, sector string, direction int, confidence double").withColumns({"window_start": F.col("bar_date"), "distinctness": F.lit(0.9), "n_members": F.lit(4)}),
        "bars": spark.createDataFrame(bars, "symbol string, kind string, bar_date date, close double"),
    }
    items = brief.items(tables["shown"])
    con = duckdb.connect()
    for name, rows in {**tables, "its": items.select("user_id", "symbol"), "rk": brief.ranked(items).select("user_id", "symbol", "place", "sector", F.lit(None).cast("int").alias("budget"))}.items():
        frame = rows.toPandas()  # noqa: F841
        con.sql(f"create table {name} as select * replace ({', '.join(f'{c}::date as {c}' for c in rows.columns if c in ('bar_date', 'last_seen', 'window_start')) or 'user_id as user_id'}) from frame")
    con.sql("create table adj as from bars")
    con.sql("create table silenced as select 0 as user_id where false")
    con.sql("create table mem as select symbol, bar_date, sector, direction from links")
    con.sql("create table themes as select distinct window_start, sector, direction, confidence, distinctness, n_members, '' as members from links")
    silenced = tables["readers"].select("user_id", "symbol").where("false")
    seen = {}
    for budget in (2, 5):
        out = brief.accounting(tables["readers"], tables["shown"], silenced, tables["links"], tables["bars"], budget)
        seen[budget] = {(r.user_id, r.rule) for r in out.select("user_id", "rule").collect()}
        sql = "WITH " + facts_sql(budget).replace("1998-12-31", "2024-03-31")
        assert seen[budget] == set(con.sql(f"{sql} select user_id, rule from ({ACCOUNTING})").fetchall())
        told = {(r.user_id, r.text) for r in out.select("user_id", "text").collect()}
        assert told == set(con.sql(f"{sql} select user_id, {TEXT} as text from ruled").fetchall())
    every = {"quiet", "sector_rotation", "sector_specific", "theme_led_market", "broad_market", "single_theme", "isolated", "scattered"}
    assert {r for _, r in seen[5]} == every
    assert {r for _, r in seen[2]} == every - {"sector_specific"}


def test_snoozed_names_are_not_normal(spark):
    day, now = dt.date(2024, 3, 28), F.lit("2024-03-31").cast("date")
    names = ["SHOWN", "CUT", "ASLEEP", "HALF", "WOKEN", "SEEN", "CALM"]
    watch = spark.createDataFrame([(1, n, "NONE", "NORMAL", dt.date(2024, 3, 20)) for n in names], "user_id long, symbol string, intent string, priority string, last_seen date")
    fired = [(n, n + "1", 0.99 if n in ("SHOWN", "CUT", "WOKEN") else 0.2) for n in names[:-1]] + [("HALF", "HALF2", 0.2)]
    context = {"sector": "A", "bar_date": day, "detector": "range_break", "family": "price", "confidence": 1.0, "is_confirmed": True, "score": 50.0, "position": 3, "resid_market": 0.0, "resid_std_market": 1.0, "severity_rank": 2}
    events = spark.createDataFrame(fired, "symbol string, fingerprint string, strength double").withColumns({k: F.lit(v) for k, v in context.items()})
    later, past = dt.date(2024, 4, 2), dt.date(2024, 3, 30)
    rows = [(1, "ASLEEP1", "SNOOZED", later), (1, "HALF1", "SNOOZED", later), (1, "WOKEN1", "SNOOZED", past), (1, "SEEN1", "SEEN", later)]
    states = spark.createDataFrame(rows, "user_id long, fingerprint string, status string, until date")
    shown = brief.visible(events, watch, states, now)
    silenced = brief.snoozed_names(brief.past_cursor(events, watch), shown, states, now)
    assert [r.symbol for r in silenced.collect()] == ["ASLEEP"]
    links = spark.createDataFrame([], "symbol string, bar_date date, window_start date, sector string, direction int, confidence double, distinctness double, n_members int")
    bars = spark.createDataFrame([], "symbol string, kind string, bar_date date, close double")
    r = brief.accounting(watch, shown, silenced, links, bars, budget=2).first()
    assert (r.n_watched, r.n_surfaced, r.n_shown, r.n_below_budget, r.n_snoozed, r.n_normal) == (7, 3, 2, 1, 1, 3)
    assert r.n_shown + r.n_below_budget + r.n_snoozed + r.n_normal == r.n_watched
    assert r.rule == "scattered"


def test_contributions_and_order(spark):
    cands = [("X", "S", dt.date(2024, 1, 2), 0, "move_since_last_seen", "price", 1, 3.0, 0.6, "move_z", "up", "h", 1.0, 1.0, 0.55, False), ("X", "S", dt.date(2024, 1, 2), 1, "volume_spike", "volume", 1, 3.0, 0.9, "rvol", "much", "h", 1.0, 1.0, 0.55, False)]
    schema = "symbol string, sector string, bar_date date, position int, detector string, family string, direction int, magnitude double, strength double, signal_key string, signal_label string, headline string, resid_market double, resid_std_market double, worst_confidence double, all_confirmed boolean"
    day = score.score_days(spark.createDataFrame(cands, schema), explain=True)
    ups, downs = score.explained(F.col("contributions"))
    r = day.select("score", "severity", ups.alias("ups"), downs.alias("downs")).first()
    # 100 * 0.6 * 0.22 / 0.36 and 100 * 0.9 * 0.14 / 0.36, then coverage 0.36 ** 0.25, confidence and dispute
    assert [(c.key, c.amount) for c in r.ups] == [("move_z", 36.7), ("rvol", 35.0)]
    assert [(c.key, c.amount) for c in r.downs] == [("corroboration", 0.77), ("data_quality", 0.78), ("unconfirmed", 0.85)]
    assert r.downs[1].label == "Data: 55/100" and r.downs[0].label == "Families: 2/5"
    assert (r.score, r.severity) == (36.6, "INFO")


def test_themes_need_a_driver_of_their_own(spark):
    """Members that move together fire, what the market explains does not, nor do two members; directions do not mix."""
    rng = random.Random(1)
    shared = [rng.gauss(0, 1) for _ in range(90)]
    day = dt.date(2024, 1, 3)

    def rows(sector, n, explained, ret=-0.05, own=0.3):
        return [(f"{sector}{i}", sector, day, 60.0 + i, ret, -2.0, [s + rng.gauss(0, own) for s in shared][i:], explained, -1 if ret < 0 else 1) for i in range(n)]

    data = rows("A", 4, -0.005) + rows("B", 4, -0.045) + rows("C", 2, 0.0) + rows("D", 2, 0.0) + rows("D", 2, 0.0, 0.05) + rows("E", 3, -0.01, own=30)
    members = spark.createDataFrame(data, "symbol string, sector string, bar_date date, score double, ret double, move_sigmas double, residuals array<double>, explained double, direction int")
    found = {(r.sector, r.direction): r for r in themes.themes(members).collect()}
    assert set(found) == {("A", -1), ("E", -1)} and found["A", -1].members == "A3,A2,A1,A0" and found["A", -1].cohesion > 0.8 and found["A", -1].band == "High"
    assert found["E", -1].cohesion < 0.4
    assert found["A", -1].summary.startswith("A down: 4 members, first A3")


def test_requests_are_checked():
    state.check_request(ids=[1] * 500, snooze_hours=336, symbol="ABC", intent="HEDGE", priority="LOW")
    for bad in ({"ids": [1] * 501}, {"snooze_hours": 0.5}, {"symbol": " "}, {"intent": "x"}, {"priority": "x"}, {"first": dt.date(2024, 2, 1), "last": dt.date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            state.check_request(**bad)


def test_one_brief_and_reasons(spark):
    from tidewatch import api

    parts = api.brief(spark, SF, 3)
    assert {r.severity for r in parts["histogram"].collect()} == {"NOISE", "INFO", "WATCH", "IMPORTANT", "CRITICAL"}
    assert parts["summary"].count() == parts["quality"].count() == 1
    assert "lift" in api.calibration_report(spark, SF)
