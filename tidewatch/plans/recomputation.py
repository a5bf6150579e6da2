"""Registered queries over late bars: what the tables hold after a recomputation of dirty ranges, beside SQL over all bars at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import recompute
from tidewatch.plans import oracle, registry
from tidewatch.plans.queries import SERIES, themes_sql
from tidewatch.plans.registry import dated, register
from tidewatch.sources import market
from tidewatch.storage import work_dir

SINCE = "1998-03-01"
# names that end with 2 or 7 get every thirteenth bar late, and another one corrected
_LATE = f"kind = 'instrument' and right(symbol, 1) in ('2', '7') and bar_date >= date '{SINCE}'"


def split_late(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is there at first, what comes late): some bars are missing at first, some have a wrong close."""
    day = F.datediff("bar_date", F.lit("1970-01-01")) % 13
    chosen = F.expr(_LATE)
    wrong = F.when(chosen & (day == 9), F.col("close_adj") * 1.02).otherwise(F.col("close_adj"))
    return bars.where(~(chosen & (day == 5))).withColumn("close_adj", wrong), bars.where(chosen & day.isin(5, 9))


def _applied(spark: SparkSession, sf_dir: str) -> recompute.Store:
    """The tables after the late bars, in two batches of which the first comes twice."""

    def make() -> DataFrame:
        root, bars = work_dir(spark, "engine"), registry.bars(spark, sf_dir)
        store, calendar, known = recompute.Store.at(spark, root), market.earnings(bars), market.instruments(spark, sf_dir)
        first, late = split_late(bars)
        recompute.start(store, first, calendar)
        early = F.col("bar_date") < "1998-07-01"
        for number, part in ((0, late.where(~early)), (0, late.where(~early)), (1, late.where(early))):
            recompute.apply(store, part, known, calendar, number)
        return spark.createDataFrame([(root,)], "root string")

    root = registry.layer(spark, sf_dir, "late-engine", make).first()["root"]
    return recompute.Store.at(spark, root)


_FIRST = f"(SELECT symbol AS s, min(bar_date) AS first_day FROM bars WHERE {_LATE} AND (bar_date - DATE '1970-01-01') % 13 IN (5, 9) GROUP BY symbol)"


@register("recompute_late_bars", oracle.scores_sql(f"""SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, detector, direction, round(magnitude, 4) AS magnitude, headline, round(score, 1) AS score, severity, fingerprint,
  coalesce(bar_date >= first_day, false) AS recomputed FROM events_scored LEFT JOIN {_FIRST} ON symbol = s"""))
def recompute_late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events after late bars; ``recomputed`` marks the rows of the dirty ranges."""
    _, late = split_late(registry.bars(spark, sf_dir))
    dirty = recompute.dirty_ranges(late, market.instruments(spark, sf_dir)).select("symbol", "first_day")
    rows = _applied(spark, sf_dir).events.read().join(dirty, "symbol", "left")
    return dated(rows.select(
        "symbol", "bar_date", "detector", "direction", F.round("magnitude", 4).alias("magnitude"), "headline", F.round("score", 1).alias("score"), "severity", "fingerprint",
        F.coalesce(F.col("bar_date") >= F.col("first_day"), F.lit(False)).alias("recomputed"),
    ))


@register("recompute_late_themes", oracle.scores_sql("SELECT CAST(window_start AS VARCHAR) AS window_start, sector, direction, n_members, members, cohesion, distinctness, confidence FROM themes", SERIES, themes_sql()))
def recompute_late_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(_applied(spark, sf_dir).themes.read().select("window_start", "sector", "direction", "n_members", "members", "cohesion", "distinctness", "confidence"), "window_start")
