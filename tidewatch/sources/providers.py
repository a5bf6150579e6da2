"""Connectors: what a source of bars gives, live feeds over HTTP, fixture files, and the earnings calendar."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewatch.operators import ingest


class BarSource(Protocol):
    """A provider of daily bars; the lower its rank, the more it is trusted."""

    source_id: str
    trust_rank: int

    def daily_bars(self, spark: SparkSession, symbols: list[str], first: str | None = None, last: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(bars, dead letters); bars hold symbol, source_id, trust_rank, bar_date, prices, close_adj, volume."""


class _Asked(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Asked]:
        return [_Asked(s) for s in self.options["symbols"].split(",") if s]

    def read(self, partition: _Asked) -> Iterator[tuple[str, str | None, str | None]]:
        named = {k: urllib.parse.quote(self.options.get(k, "")) for k in ("first", "last", "key")}
        url = self.options["url"].format(symbol=urllib.parse.quote(partition.symbol), **named)
        tries, wait = int(self.options.get("tries", "3")), float(self.options.get("wait", "30"))
        for attempt in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", "30"))) as answer:
                    yield partition.symbol, answer.read().decode(), None
                return
            except OSError as error:
                problem = str(error)[:300]
            if attempt + 1 < tries:
                time.sleep(wait * 2**attempt)
        yield partition.symbol, None, problem


class HttpBodies(DataSource):
    """``spark.read.format("http_bodies")``: one row (symbol, body, error) for each symbol, one task each.

    Options: url (with places for {symbol}, {first}, {last}, {key}), symbols, tries and wait (seconds before the second try,
    doubled at each further one), timeout. A symbol that fails at every try gives a row with the error.
    """

    @classmethod
    def name(cls) -> str:
        return "http_bodies"

    def schema(self) -> str:
        return "symbol string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class HttpSource:
    """A live feed: ``style`` says how its bodies are read, ``values`` (numbers as strings, adjusted) or ``array``
    (unadjusted, with split factors)."""

    def __init__(self, source_id: str, trust_rank: int, url: str, style: str, key: str = "", tries: int = 3, wait: float = 30.0):
        self.source_id, self.trust_rank, self.url, self.style, self.key, self.tries, self.wait = source_id, trust_rank, url, style, key, tries, wait

    def daily_bars(self, spark: SparkSession, symbols: list[str], first: str | None = None, last: str | None = None) -> tuple[DataFrame, DataFrame]:
        spark.dataSource.register(HttpBodies)
        reader = spark.read.format("http_bodies").options(url=self.url, symbols=",".join(symbols), first=first or "", last=last or "", key=self.key, tries=str(self.tries), wait=str(self.wait))
        raw = reader.load().withColumn("source_id", F.lit(self.source_id))
        failed = raw.where("body is null").select("source_id", "symbol", F.lit(None).cast("string").alias("payload"), F.col("error").alias("reason"))
        bars, letters = (ingest.parse_values if self.style == "values" else ingest.parse_array)(raw.where("body is not null"))
        return between(bars, first, last).withColumn("trust_rank", F.lit(self.trust_rank)), letters.unionByName(failed)


def between(bars: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first:
        bars = bars.where(F.col("bar_date") >= F.lit(first).cast("date"))
    return bars.where(F.col("bar_date") <= F.lit(last).cast("date")) if last else bars


# The order of fields in a compact bar.
COMPACT = ["bar_date", "open", "high", "low", "close", "close_adj", "volume"]


def write_fixtures(bars: DataFrame, path: str) -> None:
    """One JSON row for each symbol: {symbol, fields, sources: {source: [[date, open, ...], ...]}}, partitioned by symbol.

    A symbol's series are one row, as the format asks; a series is a daily history."""
    cells = F.array(F.col("bar_date").cast("string"), *[F.col(c).cast("string") for c in COMPACT[1:]])
    series = bars.groupBy("symbol", "source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bar_date", cells.alias("cells")))), lambda x: x["cells"]).alias("rows"))
    files = series.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "rows"))).alias("sources"))
    files.withColumn("fields", F.array(*[F.lit(c) for c in COMPACT])).write.mode("overwrite").partitionBy("symbol").json(path)


class FixtureSource:
    """Bars of one source from files of :func:`write_fixtures`; days outside the range are dropped while reading."""

    def __init__(self, source_id: str, trust_rank: int, path: str):
        self.source_id, self.trust_rank, self.path = source_id, trust_rank, path

    def daily_bars(self, spark: SparkSession, symbols: list[str], first: str | None = None, last: str | None = None) -> tuple[DataFrame, DataFrame]:
        files = spark.read.schema("symbol string, fields array<string>, sources map<string, array<array<string>>>").json(self.path).where(F.col("symbol").isin(symbols))
        rows = files.select("symbol", F.col("sources")[self.source_id].alias("rows"))
        letters = rows.where("rows is null").select(F.lit(self.source_id).alias("source_id"), "symbol", F.lit(None).cast("string").alias("payload"), F.lit("no such series").alias("reason"))
        cells = rows.select("symbol", F.explode("rows").alias("r")).select(
            "symbol", F.lit(self.source_id).alias("source_id"), F.lit(self.trust_rank).alias("trust_rank"), F.col("r")[0].cast("date").alias("bar_date"),
            *[F.col("r")[i].try_cast("double").alias(c) for i, c in enumerate(COMPACT) if i],
        )
        return between(cells, first, last), letters


def parse_earnings(bodies: DataFrame, known: DataFrame, body: str = "body") -> DataFrame:
    """(symbol, report_date, session, eps_estimate, eps_actual) of calendar bodies ``{"earningsCalendar": [...]}``: only
    known symbols, one row for each symbol and day, an empty session counts as none."""
    schema = "earningsCalendar array<struct<symbol string, date string, hour string, epsEstimate double, epsActual double>>"
    rows = bodies.select(F.explode(F.from_json(body, schema)["earningsCalendar"]).alias("e")).select(
        "e.symbol", F.col("e.date").try_cast("date").alias("report_date"), F.nullif("e.hour", F.lit("")).alias("session"), F.col("e.epsEstimate").alias("eps_estimate"), F.col("e.epsActual").alias("eps_actual")
    )
    rows = rows.where("report_date is not null").join(known.select("symbol"), "symbol", "left_semi")
    return rows.groupBy("symbol", "report_date").agg(F.max(F.struct("session", "eps_estimate", "eps_actual")).alias("e")).select("symbol", "report_date", "e.*")


def gather(spark: SparkSession, sources: list[BarSource], symbols: list[str], today: str, first: str | None = None, last: str | None = None) -> dict[str, DataFrame]:
    """Ingestion of some symbols from all sources: ``bars`` (reconciled), ``conflicts``, ``dead_letters``, ``runs``.

    A source that fails leaves dead letters and the others go on.
    """
    given = [s.daily_bars(spark, symbols, first, last) for s in sources]
    columns = ["source_id", "trust_rank", "symbol", *COMPACT]
    bars, letters = given[0][0].select(*columns), given[0][1]
    for more, bad in given[1:]:
        bars, letters = bars.unionByName(more.select(*columns)), letters.unionByName(bad)
    judged = ingest.validated(bars, F.lit(today).cast("date"))
    good = judged.where("problem is null").drop("problem")
    asked = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    return {
        "bars": ingest.reconciled(good), "conflicts": ingest.conflicts(good), "dead_letters": letters.unionByName(ingest.dead_letters(judged)),
        "runs": ingest.runs(asked, judged, letters, len(sources)),
    }
