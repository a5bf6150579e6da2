"""Daily bars from the sales tables: nations are instruments, regions their sectors, all sales the market.

A day's close is the mean extended price of its lines times the sector's factor of that day, to four places (a tie
always goes up). The factor is drawn by rule from sector and day: nations of a region share a driver, with rare shocks
in which much is sold and rare fortnights of wild swings, without which neither themes nor regimes could be told from
chance. Sales are summed once per nation and day; sector and market bars roll these sums up,
so the large table is aggregated a single time with partial sums. Adjusted closes differ from closes before a fixed
day for every second symbol, as after a distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKET = "MARKET"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector, proxy) of each nation; the proxy is the region's own series."""
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read(spark, sf_dir, "region", "r_regionkey", "r_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        "n_nationkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), F.concat(F.lit("SEC:"), "r_name").alias("proxy")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, kind, sector, bar_date, open, high, low, close, close_adj, volume, confidence, confirmed)."""
    lines = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    suppliers = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    daily = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", F.to_date("l_shipdate").alias("bar_date"))
        .agg(F.sum("l_extendedprice").alias("value"), F.count("l_extendedprice").alias("n"), F.sum("l_quantity").alias("volume"))
        .join(instruments(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    day = F.datediff("bar_date", F.lit("1970-01-01")).cast("long")
    drawn = F.pmod(day * day * 7 + day * (F.ascii("sector") + F.length("sector")) * 131, F.lit(1009))
    shock = drawn % 83 == 0
    swing = F.when(shock, F.when(drawn % 2 == 0, 12.0).otherwise(0.08)).otherwise(1.0)
    wild = F.when((F.floor(day / 14) + F.ascii("sector") + F.length("sector")) % 37 == 0, F.when(day % 2 == 0, 12.0).otherwise(0.08)).otherwise(1.0)
    driver = F.coalesce((1 + 9 * drawn / 1009.0) * swing * wild, F.lit(1.0))
    daily = daily.withColumns({"value": F.col("value") * driver, "volume": F.col("volume") * F.when(shock, 8).otherwise(1)})
    sums = [F.sum("value").alias("value"), F.sum("n").alias("n"), F.sum("volume").alias("volume")]
    series = daily.select("symbol", F.lit("instrument").alias("kind"), "sector", "bar_date", "value", "n", "volume")
    series = series.unionByName(daily.groupBy(F.col("proxy").alias("symbol"), "sector", "bar_date").agg(*sums).withColumn("kind", F.lit("sector")))
    series = series.unionByName(daily.groupBy("bar_date").agg(*sums).select(F.lit(MARKET).alias("symbol"), F.lit("market").alias("kind"), F.lit(None).cast("string").alias("sector"), "*"))
    order = Window.partitionBy("symbol").orderBy("bar_date")
    series = series.withColumn("close", F.round(F.col("value") / F.col("n") + 1e-7, 4))
    series = series.withColumn("open", F.coalesce(F.lag("close").over(order), "close"))
    return series.select(
        "symbol", "kind", "sector", "bar_date", "open",
        F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close",
        F.when((F.col("bar_date") < "1997-06-17") & (F.length("symbol") % 2 == 0), F.round(F.col("close") * 0.98 + 1e-7, 4)).otherwise(F.col("close")).alias("close_adj"),
        F.round("volume").cast("long").alias("volume"),
        F.when((day + F.length("symbol")) % 17 == 0, 0.9).when(day % 29 == 0, 0.55).otherwise(1.0).alias("confidence"),
        (day % 23 != 0).alias("confirmed"),
    )


def provider_bars(bars: DataFrame) -> DataFrame:
    """Instrument bars as two providers give them: the second is perturbed by day and lacks some days,
    the first lacks others."""
    own = bars.where("kind = 'instrument'").select("symbol", "bar_date", "open", "high", "low", "close", "close_adj", F.col("volume").cast("double").alias("volume"))
    day = F.datediff("bar_date", F.lit("1970-01-01")) + F.length("symbol")
    first = own.where(day % 31 != 0).select(F.lit("alpha").alias("source_id"), F.lit(1).alias("trust_rank"), "*")
    by = 1 + (day % 11 - 5) / 990.0
    second = own.where(day % 17 != 0).select(
        F.lit("beta").alias("source_id"), F.lit(2).alias("trust_rank"), "symbol", "bar_date",
        *[F.round(F.col(c) * by + 1e-7, 4).alias(c) for c in ("open", "high", "low", "close", "close_adj")],
        F.round(F.col("volume") * (1 + (day % 7) / 10.0)).alias("volume"),
    )
    return first.unionByName(second)


def faulty_bars(provided: DataFrame) -> DataFrame:
    """Provider bars with every kind of fault, dealt by day: missing, non-finite and non-positive fields, impossible
    ranges, repeated, missing and future dates."""
    day = F.pmod(F.datediff("bar_date", F.lit("1970-01-01")) + F.length("symbol"), F.lit(97))
    c = F.col
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    broken = {
        "open": F.when(day == 3, none).when(day == 59, 0.0).otherwise(c("open")),
        "high": F.when(day == 5, 0.0).when(day == 47, nan).when(day == 19, c("low") / 2).when(day == 23, c("open") * 0.75).when(day == 29, c("open") * 3).otherwise(c("high")),
        "low": F.when(day == 7, -1.0).when(day == 53, none).when(day == 23, c("open") * 0.5).when(day == 29, c("open") * 2).otherwise(c("low")),
        "close": F.when(day == 11, nan).when(day == 61, -1.0).when(day == 29, c("open") * 2).otherwise(c("close")),
        "close_adj": F.when(day == 13, 0.0).when(day == 14, none).otherwise(c("close_adj")),
        "volume": F.when(day == 17, -1.0).when(day == 43, none).otherwise(c("volume")),
        "bar_date": F.when(day == 31, F.date_add("bar_date", 200_000)).when(day == 37, F.lit(None).cast("date")).otherwise(c("bar_date")),
    }
    again = provided.where(day == 41)
    return provided.select(*[broken.get(n, c(n)).alias(n) for n in provided.columns]).unionByName(again.withColumn("volume", c("volume") + 1))


def earnings(bars: DataFrame, every: int = 63) -> DataFrame:
    """(symbol, report_date, session): the tables give no calendar, so each instrument reports every so many sessions,
    before the open on even days of the month and after the close on odd ones."""
    order = Window.partitionBy("symbol").orderBy("bar_date")
    days = bars.where("kind = 'instrument'").select("symbol", F.col("bar_date").alias("report_date"), F.row_number().over(order).alias("n"))
    session = F.when(F.dayofmonth("report_date") % 2 == 0, "bmo").otherwise("amc")
    return days.where(F.col("n") % every == 0).select("symbol", "report_date", session.alias("session"))
