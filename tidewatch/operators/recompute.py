"""Dirty ranges: late and corrected bars become ranges of (symbol, first day), and only the rows of these ranges are computed and replaced.

A row of features depends on bars before it only, so a late bar changes the rows of its symbol from its day on, and, if it is a bar
of a sector or of the market, the rows of every name that is explained by it. To compute them, the bars of a dirty
symbol are read from ``HALO`` sessions before the range on (the longest frame is 252 sessions; correlations reach back 121 sessions that the
proxy has too); the number of the bars before that, and correlations carried from before, come from the stored features. Events and days follow
from the features of the range, samples of past values from the stored rows before it. Themes are judged again for the sectors of dirty names
from their earliest dirty day on.

All tables are :class:`tidewatch.tables.Table`: partitioned by a bucket of the symbol, or by sector, so that other partitions are neither
read nor written. Each table changes in one step of its own; a batch that comes again after a loss adds nothing and completes the tables that lack it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import detect, features, score, themes
from tidewatch.storage import stored
from tidewatch.tables import Table

MARKET = "MARKET"
HALO = 400
BUCKETS = 16
EVENT = ["symbol", "sector", "bar_date", "position", "detector", "direction", "magnitude", "headline", "score", "severity_rank", "severity", "fingerprint"]
DAY = ["symbol", "sector", "bar_date", "n_events", "score", "severity_rank", "severity"]


def bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int"))


@dataclass
class Store:
    """The tables of one engine."""

    bars: Table
    features: Table
    events: Table
    days: Table
    members: Table
    themes: Table

    @staticmethod
    def at(spark: SparkSession, root: str) -> Store:
        by = {"members": "sector", "themes": "sector"}
        return Store(**{n: Table(spark, f"{root}/{n}", by.get(n, "part")) for n in ("bars", "features", "events", "days", "members", "themes")})


def dirty_ranges(late: DataFrame, instruments: DataFrame) -> DataFrame:
    """(symbol, sector, proxy, first_day) of the instruments (symbol, sector, proxy) whose rows change, from the late bars (symbol, bar_date)."""
    first = late.groupBy(F.col("symbol").alias("of")).agg(F.min("bar_date").alias("day"))
    leans = instruments.select("symbol", "sector", "proxy", F.explode(F.array("symbol", "proxy", F.lit(MARKET))).alias("of"))
    return leans.join(first, "of").groupBy("symbol", "sector", "proxy").agg(F.min("day").alias("first_day"))


def _before(old: DataFrame, dirty: DataFrame, halo: int) -> DataFrame:
    """``dirty`` with what is known of the sessions before the range: how many are left out (rn_before), the first day that is
    read (from_day, null for all), and the correlations carried."""
    known = old.join(dirty.select("symbol", "first_day"), "symbol").where("bar_date < first_day").select("symbol", "rn", "bar_date", "corr20", "corr120")
    last = known.groupBy("symbol").agg(F.max("rn").alias("rn_last"), F.max_by("corr20", "rn").alias("seed20"), F.max_by("corr120", "rn").alias("seed120"))
    start = known.join(last.select("symbol", "rn_last"), "symbol").where(F.col("rn") == F.col("rn_last") - halo + 1).select("symbol", F.col("bar_date").alias("from_day"))
    out = dirty.join(last, "symbol", "left").join(start, "symbol", "left")
    return out.withColumn("rn_before", F.greatest(F.coalesce("rn_last", F.lit(0)) - halo, F.lit(0)))


def _keys(rows: DataFrame, column: str) -> list:
    return [r[0] for r in rows.select(column).distinct().collect()]  # buckets or sectors


def _outside(dirty: DataFrame, on: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps the stored rows before the dirty range of their symbol or sector."""
    ranges = dirty.groupBy(F.col(on).alias("__on")).agg(F.min("first_day").alias("__first"))
    day = lambda df: "window_start" if "window_start" in df.columns else "bar_date"
    return lambda old: old.join(ranges, (old[on] == F.col("__on")) & (old[day(old)] >= F.col("__first")), "left_anti")


def start(store: Store, bars: DataFrame, calendar: DataFrame) -> None:
    """Fill empty tables from all bars."""
    store.bars.upsert(bucketed(bars), ["symbol", "bar_date"])
    feats = features.features(bars)
    store.features.upsert(bucketed(feats), ["symbol", "bar_date"])
    found = stored(detect.candidates(features.ready(detect.with_earnings(detect.with_samples(store.features.read().drop("part")), calendar))), "found")
    store.events.upsert(bucketed(score.score_events(found).select(*EVENT)), ["fingerprint"])
    store.days.upsert(bucketed(score.score_days(found).select(*DAY)), ["symbol", "bar_date"])
    store.members.upsert(themes.members(store.days.read().drop("part"), themes.member_series(bars)), ["symbol", "bar_date"])
    store.themes.upsert(themes.themes(store.members.read()), ["window_start", "sector", "direction"])


def apply(store: Store, late: DataFrame, instruments: DataFrame, calendar: DataFrame, batch: int, halo: int = HALO) -> DataFrame:
    """Merge late bars into the tables and bring all that depends on them up to date; returns the dirty ranges. A batch is applied once."""
    step = ("late", batch)
    if all(t.has(step) for t in vars(store).values()):
        return bucketed(dirty_ranges(late, instruments))
    store.bars.upsert(bucketed(late), ["symbol", "bar_date"], step)
    ranges = bucketed(dirty_ranges(late, instruments))
    dirty = ranges.persist()  # one row a dirty name
    parts = _keys(dirty, "part")
    if not parts:
        dirty.unpersist()
        return ranges
    known = _before(store.features.read(parts), dirty, halo)
    proxies = dirty.select(F.explode(F.array("proxy", F.lit(MARKET))).alias("symbol")).distinct()
    held = store.bars.read(sorted({*parts, *_keys(bucketed(proxies), "part")})).drop("part")
    own = held.join(known.select("symbol", "from_day", "rn_before"), "symbol").where("from_day is null or bar_date >= from_day").drop("from_day")
    around = held.join(proxies, "symbol", "left_semi")
    read = own.unionByName(around, allowMissingColumns=True)

    seeds = known.select("symbol", "first_day", "seed20", "seed120")
    feats = features.features(read).join(seeds, "symbol").where("bar_date >= first_day")
    feats = feats.withColumns({"corr20": F.coalesce("corr20", "seed20"), "corr120": F.coalesce("corr120", "seed120")}).drop("seed20", "seed120", "first_day", "rn_before")
    store.features.replace(bucketed(feats).select(*store.features.read(parts).columns), parts, _outside(dirty, "symbol"), step)

    kept = store.features.read(parts).drop("part").join(known.select("symbol", "first_day", "rn_before"), "symbol").where(F.col("rn") > F.col("rn_before")).drop("rn_before")
    wanted = kept.where("bar_date >= first_day").drop("first_day")
    found = stored(detect.candidates(features.ready(detect.with_earnings(detect.with_samples(kept.drop("first_day"), wanted), calendar.join(dirty, "symbol", "left_semi")))), "found")
    store.events.replace(bucketed(score.score_events(found).select(*EVENT)), parts, _outside(dirty, "symbol"), step)
    store.days.replace(bucketed(score.score_days(found).select(*DAY)), parts, _outside(dirty, "symbol"), step)

    sectors = _keys(dirty, "sector")
    days = store.days.read(parts).drop("part").join(dirty.select("symbol", "first_day"), "symbol").where("bar_date >= first_day").drop("first_day")
    met = themes.members(days, themes.member_series(read.drop("rn_before").join(known.select("symbol", "rn_before"), "symbol", "left")))
    store.members.replace(met.select(*store.members.read().columns), sectors, _outside(dirty, "symbol"), step)
    since = dirty.groupBy("sector").agg(F.min("first_day").alias("since"))
    rows = store.members.read(sectors).join(since, "sector").where("bar_date >= since").drop("since")
    store.themes.replace(themes.themes(rows).select(*store.themes.read().columns), sectors, _outside(dirty, "sector"), step)
    dirty.unpersist()
    return ranges

