"""Registered queries over provider bars, their storage, operations and streams, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import ingest
from tidewatch.plans import oracle, registry
from tidewatch.plans.queries import SERIES, themes_sql
from tidewatch.plans.registry import dated, register
from tidewatch.sources import market, providers
from tidewatch.storage import replaced, work_dir
from tidewatch.streaming import cursors, feeds
from tidewatch.tables import Table

TODAY = "2030-01-01"


def today():
    return F.lit(TODAY).cast("date")


PROVIDERS = f"""{oracle.BARS}, own AS (SELECT *, (bar_date - DATE '1970-01-01') + length(symbol) AS day FROM bars WHERE kind = 'instrument'),
given AS (
  SELECT 'alpha' AS source_id, 1 AS trust_rank, symbol, bar_date, open, high, low, close, close_adj, volume::DOUBLE AS volume FROM own WHERE day % 31 <> 0
  UNION ALL
  SELECT 'beta', 2, symbol, bar_date, round(open * (1 + (day % 11 - 5) / 990.0::DOUBLE) + 1e-7, 4), round(high * (1 + (day % 11 - 5) / 990.0::DOUBLE) + 1e-7, 4),
    round(low * (1 + (day % 11 - 5) / 990.0::DOUBLE) + 1e-7, 4), round(close * (1 + (day % 11 - 5) / 990.0::DOUBLE) + 1e-7, 4), round(close_adj * (1 + (day % 11 - 5) / 990.0::DOUBLE) + 1e-7, 4), round(volume * (1 + (day % 7) / 10.0::DOUBLE)) FROM own WHERE day % 17 <> 0
)"""
_RD = "coalesce(abs({0} - {1}) / nullif(greatest(abs({0}), abs({1})), 0), 0)"


def _rd(field: str) -> str:
    return _RD.format(f"p_{field}", field)


RECONCILED = f"""{PROVIDERS}, ranked AS (
  SELECT *, row_number() OVER o AS nth, first_value(source_id) OVER o AS p_source, {', '.join(f'first_value({c}) OVER o AS p_{c}' for c in ('open', 'high', 'low', 'close', 'volume'))}
  FROM given WINDOW o AS (PARTITION BY symbol, bar_date ORDER BY trust_rank, source_id)
), worst AS (
  SELECT symbol, bar_date, count(*) AS n_sources, max(greatest({', '.join(f'CASE WHEN {_rd(c)} > 0.003 THEN {_rd(c)} END' for c in ('open', 'high', 'low', 'close'))})) AS worst,
    list_sort(list(DISTINCT source_id)) AS sources FROM ranked GROUP BY symbol, bar_date
)"""


@register("ingest_reconcile", "WITH " + RECONCILED + """
SELECT r.symbol, CAST(r.bar_date AS VARCHAR) AS bar_date, source_id, round(close, 4) AS close, volume,
  CASE WHEN n_sources = 1 THEN 0.9 WHEN worst IS NULL THEN 1.0 ELSE greatest(0.5, least(1, round(1 - (worst - 0.003) / (0.1 - 0.003) / 2, 3))) END::DOUBLE AS confidence,
  worst IS NULL AS confirmed, n_sources, array_to_string(sources, ',') AS sources
FROM ranked r JOIN worst w ON r.symbol = w.symbol AND r.bar_date = w.bar_date WHERE nth = 1""")
def ingest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.reconciled(registry.provided(spark, sf_dir))
    return out.select("symbol", F.col("bar_date").cast("string").alias("bar_date"), "source_id", F.round("close", 4).alias("close"), "volume", "confidence", "confirmed", "n_sources", F.concat_ws(",", "sources").alias("sources"))


@register("ingest_conflicts", "WITH " + RECONCILED + ", long AS (" + " UNION ALL ".join(
    f"SELECT symbol, bar_date, p_source, source_id, '{c}' AS field, p_{c}::DOUBLE AS pv, {c}::DOUBLE AS ov, {_rd(c)} AS delta, {0.25 if c == 'volume' else 0.003} AS tol FROM ranked WHERE nth > 1" for c in ("open", "high", "low", "close", "volume")
) + ") SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, p_source AS primary_source, source_id AS other_source, field, round(pv, 4) AS primary_value, round(ov, 4) AS other_value, round(delta, 5) AS delta, p_source AS resolved_to FROM long WHERE delta > tol")
def ingest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.conflicts(registry.provided(spark, sf_dir))
    return dated(out.select("symbol", "bar_date", "primary_source", "other_source", "field", F.round("primary_value", 4).alias("primary_value"), F.round("other_value", 4).alias("other_value"), F.round("delta", 5).alias("delta"), "resolved_to"))


@register("ingest_gaps_filled", "WITH " + PROVIDERS + " SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date FROM given GROUP BY symbol, bar_date HAVING min(trust_rank) > 1")
def ingest_gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.gaps_filled(registry.provided(spark, sf_dir)).select("symbol", F.col("bar_date").cast("string").alias("bar_date"))


@register("ingest_split_adjust", "WITH " + PROVIDERS + """, f AS (SELECT *, CASE WHEN day(bar_date) = 7 AND month(bar_date) % 6 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS split_factor FROM given WHERE source_id = 'beta'),
g AS (SELECT *, coalesce(exp(sum(ln(split_factor)) OVER (PARTITION BY symbol, source_id ORDER BY bar_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) AS fac FROM f)
SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, round(round(close / fac, 6) + 1e-5, 2) AS close FROM g""")
def ingest_split_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when((F.dayofmonth("bar_date") == 7) & (F.month("bar_date") % 6 == 0), 2.0).otherwise(1.0)
    out = ingest.split_adjusted(registry.provided(spark, sf_dir).where("source_id = 'beta'").withColumn("split_factor", factor))
    return out.select("symbol", F.col("bar_date").cast("string").alias("bar_date"), F.round(F.col("close") + 1e-5, 2).alias("close"))


FAULTY = PROVIDERS + """, dealt AS (SELECT *, ((bar_date - DATE '1970-01-01') + length(symbol)) % 97 AS fault FROM given),
faulty AS (
  SELECT source_id, trust_rank, symbol, CASE fault WHEN 31 THEN bar_date + 200000 WHEN 37 THEN NULL ELSE bar_date END AS bar_date, CASE fault WHEN 3 THEN NULL WHEN 59 THEN 0 ELSE open END AS open,
    CASE fault WHEN 5 THEN 0 WHEN 47 THEN 'NaN'::DOUBLE WHEN 19 THEN low / 2 WHEN 23 THEN open * 0.75::DOUBLE WHEN 29 THEN open * 3 ELSE high END AS high, CASE fault WHEN 7 THEN -1 WHEN 53 THEN NULL WHEN 23 THEN open * 0.5::DOUBLE WHEN 29 THEN open * 2 ELSE low END AS low,
    CASE fault WHEN 11 THEN 'NaN'::DOUBLE WHEN 61 THEN -1 WHEN 29 THEN open * 2 ELSE close END AS close, CASE fault WHEN 13 THEN 0 WHEN 14 THEN NULL ELSE close_adj END AS close_adj, CASE fault WHEN 17 THEN -1 WHEN 43 THEN NULL ELSE volume END AS volume
  FROM dealt UNION ALL SELECT source_id, trust_rank, symbol, bar_date, open, high, low, close, close_adj, volume + 1 FROM dealt WHERE fault = 41
)"""
_FIELD = " ".join(f"WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN '{c} is not finite' WHEN {c} <= 0 THEN '{c} is not positive'" for c in ("open", "high", "low", "close", "close_adj"))
VALIDATED = "WITH RECURSIVE " + FAULTY + f""", static AS (
  SELECT *, CASE {_FIELD} WHEN volume IS NULL OR volume < 0 THEN 'volume is not valid' WHEN high < low THEN 'high below low' WHEN high < greatest(open, close) THEN 'high below open or close'
    WHEN low > least(open, close) THEN 'low above open or close' WHEN bar_date > DATE '{TODAY}' + 1 THEN 'dated in the future' END AS own_problem FROM faulty
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, source_id ORDER BY bar_date NULLS FIRST, trust_rank, open NULLS FIRST, high, low NULLS FIRST, close, close_adj NULLS FIRST, volume NULLS FIRST) AS nth FROM static
), fold AS (
  SELECT symbol, source_id, 0::BIGINT AS nth, '' AS problem, NULL::DATE AS day, NULL::DOUBLE AS kept FROM numbered WHERE nth = 1
  UNION ALL
  SELECT n.symbol, n.source_id, n.nth, p.problem, CASE WHEN p.problem = '' THEN n.bar_date ELSE f.day END, CASE WHEN p.problem = '' THEN n.close ELSE f.kept END
  FROM fold f JOIN numbered n ON n.symbol = f.symbol AND n.source_id = f.source_id AND n.nth = f.nth + 1,
    LATERAL (SELECT CASE WHEN n.bar_date IS NULL THEN 'malformed date' WHEN n.bar_date = f.day THEN 'duplicate date' WHEN n.own_problem IS NOT NULL THEN n.own_problem
      WHEN n.bar_date - f.day BETWEEN 1 AND 4 AND abs(n.close / f.kept - 1) > 0.6 THEN 'implausible move' ELSE '' END AS problem) p
), judged AS (SELECT n.*, nullif(f.problem, '') AS problem FROM numbered n JOIN fold f ON n.symbol = f.symbol AND n.source_id = f.source_id AND n.nth = f.nth)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.layer(spark, sf_dir, "judged", lambda: ingest.validated(market.faulty_bars(registry.provided(spark, sf_dir)), today()), "symbol", "source_id")


@register("ingest_validate", VALIDATED + " SELECT symbol, source_id, CAST(bar_date AS VARCHAR) AS bar_date, round(close, 4) AS close, problem FROM judged")
def ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(judged(spark, sf_dir).select("symbol", "source_id", "bar_date", F.round("close", 4).alias("close"), "problem"))


@register("ingest_validate_pieces", VALIDATED + " SELECT symbol, source_id, CAST(bar_date AS VARCHAR) AS bar_date, round(close, 4) AS close, problem FROM judged")
def ingest_validate_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series cut into pieces of 90 days that are judged apart and composed; the SQL goes from bar to bar."""
    out = ingest.validated_in_pieces(market.faulty_bars(registry.provided(spark, sf_dir)), today(), 90)
    return dated(out.select("symbol", "source_id", "bar_date", F.round("close", 4).alias("close"), "problem"))


@register("ingest_reasons", VALIDATED + " SELECT source_id, problem, count(*) AS n FROM judged GROUP BY ALL")
def ingest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy("source_id", "problem").agg(F.count("*").alias("n"))


@register("ingest_dead_letters", VALIDATED + " SELECT source_id, symbol, problem AS reason, CAST(bar_date AS VARCHAR) AS bar_date, round(open, 4) AS open, round(volume, 1) AS volume FROM judged WHERE problem IS NOT NULL")
def ingest_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected bars with their reason; the payload is JSON, of which three fields are read back here."""
    letters = ingest.dead_letters(judged(spark, sf_dir)).withColumn("p", F.from_json("payload", "bar_date string, open double, volume double"))
    return letters.select("source_id", "symbol", "reason", "p.bar_date", F.round("p.open", 4).alias("open"), F.round("p.volume", 1).alias("volume"))


_FAILED = "symbol LIKE 'NATION_1%'"  # the second provider fails for these, and the first one too where the name is long
_RUNS = f""", kept AS (SELECT * FROM judged WHERE NOT ({_FAILED} AND (source_id = 'beta' OR length(symbol) > 8))),
runs AS (SELECT s.symbol, CASE g.given WHEN 2 THEN 'ok' WHEN 1 THEN 'partial' ELSE 'failed' END AS status, coalesce(g.rows_in, 0) AS rows_in, coalesce(b.n, 0) AS rows_rejected,
  CASE WHEN {_FAILED.replace('symbol', 's.symbol')} THEN CASE WHEN length(s.symbol) > 8 THEN 'alpha: no answer; beta: no answer' ELSE 'beta: no answer' END END AS note
FROM (SELECT DISTINCT symbol FROM judged) s LEFT JOIN (SELECT symbol, count(DISTINCT source_id) AS given, count(DISTINCT bar_date) AS rows_in FROM kept WHERE problem IS NULL GROUP BY symbol) g ON s.symbol = g.symbol
  LEFT JOIN (SELECT symbol, count(*) AS n FROM kept WHERE problem IS NOT NULL GROUP BY symbol) b ON s.symbol = b.symbol)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    lost = F.expr(f"{_FAILED} and (source_id = 'beta' or length(symbol) > 8)")
    failures = rows.where(lost).select("source_id", "symbol", F.lit("no answer").alias("reason")).distinct()
    return ingest.runs(rows.select("symbol"), rows.where(~lost), failures)


@register("ingest_runs", VALIDATED + _RUNS + " SELECT * FROM runs")
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ingestion of each symbol ended."""
    return _runs(spark, sf_dir)


@register("ingest_run_totals", VALIDATED + _RUNS + " SELECT count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, sum(rows_in)::BIGINT AS rows_in, sum(rows_rejected)::BIGINT AS rows_rejected FROM runs")
def ingest_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_totals(_runs(spark, sf_dir))


# ---- provider bodies and files -----------------------------------------------------------------

# every fifth value in a body is missing, not a number or infinite; every ninth body is an error, every eleventh is cut short
_BODY = f"""{PROVIDERS}, src AS (SELECT *, year(bar_date) AS yr, (year(bar_date) * 7 + length(symbol)) AS kind FROM given WHERE source_id = 'alpha'),
bodies AS (SELECT DISTINCT symbol, yr, kind FROM src)"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.provided(spark, sf_dir).where("source_id = 'alpha'").withColumns({"yr": F.year("bar_date"), "kind": F.year("bar_date") * 7 + F.length("symbol")})


def _value_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bodies(spark, sf_dir)
    text = {c: F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "volume")}
    close = F.when(F.dayofmonth("bar_date") == 5, "n/a").when(F.dayofmonth("bar_date") == 6, "Infinity").when(F.dayofmonth("bar_date") == 7, F.lit(None)).otherwise(F.col("close").cast("string"))
    volume = F.when(F.dayofmonth("bar_date") == 9, "none").otherwise(F.col("volume").cast("string"))
    date = F.when(F.dayofmonth("bar_date") == 8, F.date_format("bar_date", "yyyy-M-d")).when(F.dayofmonth("bar_date") == 11, F.date_format("bar_date", "yyyy")).otherwise(F.col("bar_date").cast("string"))
    value = F.struct(F.concat(date, F.lit(" 00:00:00")).alias("datetime"), text["open"], text["high"], text["low"], close.alias("close"), volume.alias("volume"))
    made = rows.groupBy("symbol", "yr", "kind").agg(F.to_json(F.struct(F.lit(0).alias("code"), F.collect_list(value).alias("values"))).alias("body"))
    body = F.when(F.col("kind") % 9 == 0, F.lit('{"status": "error", "code": 429, "message": "out of credits"}')).when(F.col("kind") % 11 == 0, F.lit('{"values": []}')).otherwise(F.col("body"))
    return made.select("symbol", F.lit("alpha").alias("source_id"), body.alias("body"))


@register("ingest_parse_values", "WITH " + _BODY + " SELECT symbol, CASE WHEN day(bar_date) NOT IN (8, 11) THEN CAST(bar_date AS VARCHAR) END AS bar_date, round(close, 4) AS close, round(close, 4) AS close_adj, CASE WHEN day(bar_date) = 9 THEN 0 ELSE volume END AS volume FROM src WHERE kind % 9 <> 0 AND kind % 11 <> 0 AND day(bar_date) NOT IN (5, 6, 7)")
def ingest_parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of one year each, with numbers as strings, a code of 0 and dates that are not ISO dates, read back."""
    out, _ = ingest.parse_values(_value_bodies(spark, sf_dir))
    return dated(out.select("symbol", "bar_date", F.round("close", 4).alias("close"), F.round("close_adj", 4).alias("close_adj"), "volume"))


@register("ingest_body_letters", "WITH " + _BODY + " SELECT symbol, CASE WHEN kind % 9 = 0 THEN 'out of credits' ELSE 'no values in response' END AS reason, count(*) AS n FROM bodies WHERE kind % 9 = 0 OR kind % 11 = 0 GROUP BY ALL")
def ingest_body_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that gave no bar, by reason."""
    _, letters = ingest.parse_values(_value_bodies(spark, sf_dir))
    return letters.groupBy("symbol", "reason").agg(F.count("*").alias("n"))


@register("ingest_parse_array", "WITH " + _BODY + """, f AS (SELECT *, CASE WHEN day(bar_date) = 7 AND month(bar_date) % 6 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS sf FROM src WHERE day(bar_date) <> 5),
g AS (SELECT *, coalesce(exp(sum(ln(sf)) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) AS fac FROM f)
SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, round(round(close / fac, 6) + 1e-5, 2) AS close_adj, floor(volume * round(fac) + 0.5)::DOUBLE AS volume FROM g""")
def ingest_parse_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unadjusted body for each symbol, with splits and some numbers as strings, read back."""
    factor = F.when((F.dayofmonth("bar_date") == 7) & (F.month("bar_date") % 6 == 0), 2.0).otherwise(1.0)
    close = F.when(F.dayofmonth("bar_date") != 5, F.col("close"))
    row = F.struct(F.col("bar_date").cast("string").alias("date"), "open", F.concat(F.lit(" "), F.col("high").cast("string")).alias("high"), "low", close.cast("string").alias("close"), F.col("volume").cast("string").alias("volume"), factor.cast("string").alias("splitFactor"))
    bodies = _bodies(spark, sf_dir).groupBy("symbol", "source_id").agg(F.to_json(F.collect_list(row)).alias("body"))
    out, _ = ingest.parse_array(bodies)
    return dated(out.select("symbol", "bar_date", F.round(F.col("close_adj") + 1e-5, 2).alias("close_adj"), "volume"))


@register("ingest_fixtures", "WITH " + PROVIDERS + " SELECT source_id, symbol, CAST(bar_date AS VARCHAR) AS bar_date, round(open, 4) AS open, round(close_adj, 4) AS close_adj, volume FROM given WHERE bar_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND symbol < 'NATION_2'")
def ingest_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources from compact files: two years of the symbols before NATION_2, written and read back."""
    path = work_dir(spark, "fixtures")
    providers.write_fixtures(registry.provided(spark, sf_dir), path)
    symbols = [r.symbol for r in market.instruments(spark, sf_dir).where("symbol < 'NATION_2'").collect()]  # the dimension: 25 rows
    given = [providers.FixtureSource(s, rank, path).daily_bars(spark, symbols, "1996-01-01", "1997-12-31")[0] for s, rank in (("alpha", 1), ("beta", 2))]
    return dated(given[0].unionByName(given[1]).select("source_id", "symbol", "bar_date", F.round("open", 4).alias("open"), F.round("close_adj", 4).alias("close_adj"), "volume"))


@register("ingest_padded", oracle.bars_sql("""SELECT DISTINCT symbol, CAST(bar_date AS VARCHAR) AS bar_date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS n FROM bars WHERE kind = 'instrument') b
JOIN (SELECT symbol AS s, name, min(n) - 320 AS a, max(n) AS z FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS n FROM bars WHERE kind = 'instrument') x
  JOIN (VALUES ('first', DATE '1995-02-24', DATE '1995-03-31'), ('second', DATE '1998-01-15', DATE '1998-02-07'), ('last', DATE '2000-06-01', DATE '2100-01-01')) w(name, first, until) ON x.bar_date BETWEEN first AND until GROUP BY ALL) r
ON b.symbol = r.s AND b.n BETWEEN r.a AND r.z"""))
def ingest_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of three windows, each with 320 sessions before it."""
    windows = spark.createDataFrame([("first", "1995-02-24", "1995-03-31"), ("second", "1998-01-15", "1998-02-07"), ("last", "2000-06-01", "2100-01-01")], "name string, low string, high string")
    windows = windows.select("name", F.col("low").cast("date").alias("low"), F.col("high").cast("date").alias("high"))
    return dated(ingest.padded(registry.bars(spark, sf_dir).where("kind = 'instrument'").select("symbol", "bar_date"), windows))


@register("earnings_calendar", oracle.bars_sql("""SELECT symbol, CAST(bar_date AS VARCHAR) AS report_date, CASE WHEN length(symbol) % 2 = 0 THEN CASE WHEN day(bar_date) % 2 = 0 THEN 'bmo' ELSE 'amc' END END AS session, length(symbol) / 4.0::DOUBLE AS eps_estimate
FROM (SELECT symbol, bar_date, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS n FROM bars WHERE kind = 'instrument') WHERE n % 63 = 0"""))
def earnings_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar as bodies of one year each, with repeated and unknown names, read back."""
    rows = market.earnings(registry.bars(spark, sf_dir)).withColumn("yr", F.year("report_date"))
    hour = F.when(F.length("symbol") % 2 == 0, F.col("session")).otherwise("")
    entry = F.struct("symbol", F.col("report_date").cast("string").alias("date"), hour.alias("hour"), (F.length("symbol") / 4.0).alias("epsEstimate"))
    listed = rows.select("yr", F.explode(F.array(entry, entry, F.struct(F.concat("symbol", F.lit("?")).alias("symbol"), entry["date"].alias("date"), entry["hour"].alias("hour"), entry["epsEstimate"].alias("epsEstimate")))).alias("e"))
    bodies = listed.groupBy("yr").agg(F.to_json(F.struct(F.collect_list("e").alias("earningsCalendar"))).alias("body"))
    out = providers.parse_earnings(bodies, market.instruments(spark, sf_dir))
    return dated(out.select("symbol", "report_date", "session", "eps_estimate"), "report_date")


# ---- storage -----------------------------------------------------------------------------------


@register("ingest_insert_if_absent", "WITH " + PROVIDERS + """ SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date FROM (SELECT * FROM given WHERE source_id = 'beta') b
ANTI JOIN (SELECT symbol, bar_date FROM given WHERE source_id = 'alpha') a USING (symbol, bar_date)""")
def ingest_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = registry.provided(spark, sf_dir)
    out = ingest.insert_if_absent(given.where("source_id = 'beta'"), given.where("source_id = 'alpha'"), ["symbol", "bar_date"])
    return dated(out.select("symbol", "bar_date"))


@register("ingest_upsert", "WITH " + PROVIDERS + """ SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, arg_max(source_id, (volume, source_id)) AS source_id, max(volume) AS volume FROM given GROUP BY ALL""")
def ingest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second provider's bars over the first one's: of each symbol and day the one with more volume, the new one on a tie."""
    given = registry.provided(spark, sf_dir).select("symbol", "bar_date", "source_id", "volume")
    return dated(ingest.upsert(given.where("source_id = 'alpha'"), given.where("source_id = 'beta'"), ["symbol", "bar_date"], "volume"))


@register("events_append", oracle.scores_sql("SELECT severity, count(*) AS n, count(DISTINCT fingerprint) AS n_fingerprints FROM events_scored GROUP BY severity"))
def events_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in three overlapping deliveries, two of which come twice; the fingerprint keeps each event once."""
    rows = registry.events(spark, sf_dir).withColumn("yr", F.year("bar_date"))
    table, month = Table(spark, work_dir(spark, "events"), "yr"), F.month("bar_date")
    parts = [rows.where(month <= 7), rows.where((month >= 3) & (month <= 10)), rows.where((month >= 6) | (month <= 2))]
    for number in (0, 1, 1, 0, 2):  # deliveries come again
        table.insert_absent(parts[number], ["fingerprint"], ("deliveries", number))
    return table.read().groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("n_fingerprints"))


@register("events_replace", oracle.scores_sql("""SELECT fingerprint, CAST(bar_date AS VARCHAR) AS bar_date, CASE WHEN bar_date BETWEEN DATE '1997-03-01' AND DATE '1997-08-31' THEN 'second' ELSE 'first' END AS run
FROM events_scored WHERE NOT bar_date BETWEEN DATE '1997-03-01' AND DATE '1997-08-31' OR severity_rank > 0"""))
def events_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year of events replaced by a second run that keeps no noise."""
    rows = registry.events(spark, sf_dir).select("fingerprint", "bar_date", "severity_rank")
    new = rows.where("severity_rank > 0").withColumn("run", F.lit("second"))
    out = replaced(rows.withColumn("run", F.lit("first")), new, "bar_date", "1997-03-01", "1997-08-31")
    return dated(out.select("fingerprint", "bar_date", "run"))


@register("basis_diagnostic", "WITH " + PROVIDERS + """ SELECT a.symbol, count(*) AS n, round(avg(b.close / a.close), 5) AS mean_ratio FROM given a JOIN given b
ON a.symbol = b.symbol AND a.bar_date = b.bar_date AND a.source_id = 'alpha' AND b.source_id = 'beta' GROUP BY a.symbol""")
def basis_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = registry.provided(spark, sf_dir)
    a = given.where("source_id = 'alpha'").select("symbol", "bar_date", F.col("close").alias("a"))
    b = given.where("source_id = 'beta'").select("symbol", "bar_date", F.col("close").alias("b"))
    return a.join(b, ["symbol", "bar_date"]).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") / F.col("a")), 5).alias("mean_ratio"))


# ---- operations --------------------------------------------------------------------------------


@register("ops_counts", oracle.scores_sql("""SELECT (SELECT count(*) FROM worst) AS n_bars, (SELECT count(*) FROM worst WHERE worst IS NOT NULL) AS n_unconfirmed, (SELECT count(*) FROM worst WHERE n_sources = 1 OR round(1 - (worst - 0.003) / (0.1 - 0.003) / 2, 3) < 1) AS n_unsure,
  (SELECT count(*) FROM worst WHERE n_sources = 1) AS n_single_source, (SELECT count(*) FROM long WHERE delta > tol) AS n_conflicts, (SELECT count(*) FROM themes) AS n_themes, (SELECT count(*) FROM events_scored) AS n_events,
  (SELECT count(*) FROM (SELECT DISTINCT symbol, year(bar_date) * 7 + length(symbol) AS kind, year(bar_date) AS yr FROM given WHERE source_id = 'alpha') WHERE kind % 9 = 0 OR kind % 11 = 0) AS n_dead_letters""",
  SERIES, themes_sql(), RECONCILED[RECONCILED.index("own AS (") :] + ", long AS (" + " UNION ALL ".join(
    f"SELECT {_rd(c)} AS delta, {0.25 if c == 'volume' else 0.003} AS tol FROM ranked WHERE nth > 1" for c in ("open", "high", "low", "close", "volume")) + ")"))
def ops_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operations page counts, one pass for each table."""
    from tidewatch.operators import themes

    given = registry.provided(spark, sf_dir)
    counts = ingest.reconciled(given).agg(
        F.count("*").alias("n_bars"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed"), F.count_if(F.col("confidence") < 1).alias("n_unsure"), F.count_if(F.col("n_sources") == 1).alias("n_single_source")
    )
    others = {"n_conflicts": ingest.conflicts(given), "n_themes": themes.themes(registry.members(spark, sf_dir)), "n_events": registry.events(spark, sf_dir), "n_dead_letters": ingest.parse_values(_value_bodies(spark, sf_dir))[1]}
    return counts.select("*", *[df.agg(F.count("*")).scalar().alias(name) for name, df in others.items()])


@register("ops_last_runs", VALIDATED + _RUNS + """, attempts AS (
  SELECT symbol, m, CASE WHEN m = 0 THEN status WHEN (length(symbol) + m) % 4 = 0 THEN 'running' WHEN (length(symbol) + m) % 4 = 1 THEN 'failed' ELSE 'ok' END AS status, DATE '2001-12-31' - m * 3 - CAST(ascii(right(symbol, 1)) % 3 AS INTEGER) AS started
  FROM runs, (VALUES (0), (1), (2), (3)) v(m))
SELECT symbol, status, CAST(started AS VARCHAR) AS started, row_number() OVER (ORDER BY started DESC, symbol, status) AS place FROM attempts QUALIFY place <= 8""")
def ops_last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight runs that began last, those still running included (a report of the newest)."""
    ended, size, m = _runs(spark, sf_dir).select("symbol", "status"), F.length("symbol"), F.col("m")
    rows = ended.withColumn("m", F.explode(F.array(*map(F.lit, range(4)))))
    begun = F.date_sub(F.lit("2001-12-31").cast("date"), (m * 3 + F.ascii(F.right("symbol", F.lit(1))) % 3).cast("int"))
    started = ingest.begun(rows.select("symbol", "m", begun.alias("started")))
    done = rows.select("symbol", "m", F.when(m == 0, F.col("status")).when((size + m) % 4 == 1, "failed").when((size + m) % 4 > 1, "ok").alias("status")).where("status is not null")
    return dated(ingest.last_runs(ingest.ended(started, done, ["symbol", "m"]), 8).select("symbol", "status", "started", "place"), "started")


def fresh_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of the event feeds by type: an event of every seventh user counts as a failed attempt."""
    rows = market.read(spark, sf_dir, "events", "ts", "event_type", "user_id")
    error = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("user "), F.col("user_id").cast("string")))
    out = ingest.freshness(rows.select(F.col("event_type").alias("source_id"), F.lit("event").alias("kind"), F.col("ts").cast("timestamp").alias("at"), error.alias("error")))
    return out.withColumn("last_success", F.to_date("last_success"))


FRESH = """
att AS (SELECT event_type AS source_id, CAST(ts AS TIMESTAMP) AS tried_at, CASE WHEN user_id % 7 = 0 THEN 'user ' || user_id END AS error FROM events),
good AS (SELECT source_id, max(tried_at) FILTER (error IS NULL) AS ok, max(tried_at) AS tried FROM att GROUP BY source_id),
fresh AS (SELECT g.source_id, 'event' AS kind, CAST(ok AS DATE) AS last_success, CAST(tried AS DATE) AS last_attempt, (SELECT count(*) FROM att a WHERE a.source_id = g.source_id AND a.error IS NOT NULL AND (g.ok IS NULL OR a.tried_at > g.ok)) AS consecutive_failures FROM good g)"""


@register("ops_freshness", "WITH " + FRESH + " SELECT source_id, kind, CAST(last_success AS VARCHAR) AS last_success, CAST(last_attempt AS VARCHAR) AS last_attempt, consecutive_failures FROM fresh")
def ops_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_sources(spark, sf_dir).withColumn("last_attempt", F.to_date("last_attempt"))
    return dated(out.drop("last_error"), "last_success", "last_attempt")


SOURCES = [("view", "event", 1), ("click", "event", 2), ("purchase", "event", 3), ("signup", "event", 4), ("error", "event", 5), ("view", "bar", 6), ("archive", "event", 7)]


@register("ops_sources", "WITH " + FRESH + f" SELECT s.source_id, s.kind, s.trust_rank, CAST(f.last_success AS VARCHAR) AS last_success, f.consecutive_failures FROM (VALUES {', '.join(map(str, SOURCES))}) s(source_id, kind, trust_rank) LEFT JOIN fresh f ON s.source_id = f.source_id AND s.kind = f.kind")
def ops_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known source with its freshness, if it was ever tried."""
    known = spark.createDataFrame(SOURCES, "source_id string, kind string, trust_rank int")
    return dated(ingest.source_health(known, fresh_sources(spark, sf_dir)).select("source_id", "kind", "trust_rank", "last_success", "consecutive_failures"), "last_success")


@register("ops_stalest", "WITH " + FRESH + " SELECT source_id, CAST(last_success AS VARCHAR) AS last_success FROM fresh ORDER BY fresh.last_success NULLS LAST, source_id LIMIT 1")
def ops_stalest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(ingest.stalest(fresh_sources(spark, sf_dir)).select("source_id", "last_success"), "last_success")


@register("debounce_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT user_id, count(*) AS n, CAST(min(ts) AS VARCHAR)[1:19] AS start FROM s GROUP BY user_id, burst""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = market.read(spark, sf_dir, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return out.select("user_id", "n", F.date_format(F.col("session_window.start"), "yyyy-MM-dd HH:mm:ss").alias("start"))


@register("state_woken", """WITH asked AS (SELECT user_id, event_type AS symbol, ts, max(ts + INTERVAL 1 HOUR * (1 + event_id % 48)) AS until FROM events WHERE ts IS NOT NULL GROUP BY ALL),
s AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, symbol ORDER BY ts) AS after FROM asked)
SELECT user_id, symbol, CAST(ts AS VARCHAR)[1:19] AS asked, CAST(until AS VARCHAR)[1:19] AS woken FROM s WHERE (after IS NULL OR after > until) AND until <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def state_woken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a snooze of up to two days of its type; timers of the stream wake those that no later one has replaced."""
    hours = F.make_dt_interval(hours=(1 + F.col("event_id") % 48).cast("int"))
    # a table's files are in no order of time, so all are one batch and none comes late
    stream = feeds.event_stream(spark, f"{sf_dir}/events*.parquet", 1_000_000)
    snoozes = stream.select("user_id", F.col("event_type").alias("symbol"), F.col("ts").alias("at"), (F.col("ts") + hours).alias("until"))
    folder = work_dir(spark, "woken")
    write = cursors.woken(snoozes, "1 day").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    feeds.restarted(lambda: write.start(f"{folder}/rows"))
    rows = spark.read.schema("user_id long, symbol string, at timestamp, until timestamp").parquet(f"{folder}/rows")
    said = {name: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for name, c in (("asked", "at"), ("woken", "until"))}
    return rows.select("user_id", "symbol", *[c.alias(name) for name, c in said.items()])
