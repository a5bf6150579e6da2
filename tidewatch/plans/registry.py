"""Where queries and their DuckDB SQL are kept, and the layers that they share.

A layer is written once for the input files as they are, to the shared folder, and read by every query after that: the large table is scanned and
summed once, and no query computes features, events or members of themes again. When a file of an input changes, the next query writes another version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import tables
from tidewatch.operators import detect, score, themes
from tidewatch.operators import features as feature_ops
from tidewatch.sources import market


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Adding 0.0 turns a negative zero into zero."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def round_sql(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def dated(df: DataFrame, *names: str) -> DataFrame:
    """Dates as strings, which compare alike everywhere."""
    return df.withColumns({n: F.col(n).cast("string") for n in names or ("bar_date",)})


#: The tables that layers are made of.
MARKET = ("lineitem", "supplier", "nation", "region")
READERS = (*MARKET, "customer")


def layer(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], *cluster: str, over: tuple[str, ...] = MARKET, params: str = "") -> DataFrame:
    """A versioned layer over the named tables of ``sf_dir``."""
    return tables.layer(spark, name, [f"{sf_dir}/{t}.parquet" for t in over], make, *cluster, params=params)


DAY = "CAST(bar_date AS VARCHAR) AS bar_date"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "bars", lambda: market.bars(spark, sf_dir), "symbol", "bar_date")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "features", lambda: feature_ops.features(bars(spark, sf_dir)), "symbol", "bar_date")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        rows = detect.with_earnings(detect.with_samples(features(spark, sf_dir)), market.earnings(bars(spark, sf_dir)))
        return detect.candidates(feature_ops.ready(rows))

    return layer(spark, sf_dir, "candidates", make, "symbol", "bar_date")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "events", lambda: score.score_events(candidates(spark, sf_dir)), "symbol", "bar_date")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "days", lambda: score.score_days(candidates(spark, sf_dir)), "symbol", "bar_date")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "members", lambda: themes.members(days(spark, sf_dir), themes.member_series(bars(spark, sf_dir))), "bar_date", "sector")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "links", lambda: themes.linked(members(spark, sf_dir)), "symbol", "bar_date")


def provided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.provider_bars(bars(spark, sf_dir))
