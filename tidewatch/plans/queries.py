"""The registered queries over bars, features, detectors, scores, themes and calibration, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.functions.expr import SEVERITIES
from tidewatch.operators import detect, features, score, themes
from tidewatch.plans import oracle, registry
from tidewatch.plans.registry import DAY, ORACLES, QUERIES, dated, register, round_sql, rounded

__all__ = ["ORACLES", "QUERIES"]

# ---- bars and features -------------------------------------------------------------------------


@register("bars_daily", oracle.bars_sql(f"SELECT symbol, kind, sector, CAST(bar_date AS VARCHAR) AS bar_date, {round_sql(4, 'open', 'high', 'low', 'close', 'close_adj')}, volume, confidence, confirmed FROM bars"))
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(registry.bars(spark, sf_dir), 4, "open", "high", "low", "close", "close_adj")
    return df.withColumn("bar_date", F.col("bar_date").cast("string"))


def _feature_query(name: str, digits: int, *columns: str) -> None:
    sql = oracle.feats_sql(f"SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, {round_sql(digits, *columns)} FROM feats WHERE rn >= 60")

    @register(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = features.ready(registry.features(spark, sf_dir))
        return rounded(df.select("symbol", F.col("bar_date").cast("string").alias("bar_date"), *columns), digits, *columns)


_feature_query("feat_returns", 6, "ret1d", "log_ret")
_feature_query("feat_volatility", 6, "sigma20", "rv10", "rv60")
_feature_query("feat_atr_sma", 6, "atr14", "sma20", "sma50")
_feature_query("feat_ranges", 6, "high20", "low20", "high60", "low60", "high252", "low252")
_feature_query("feat_rvol", 6, "median_volume20", "rvol", "rvol_past")
_feature_query("feat_beta_market", 4, "beta_market", "resid_market", "resid_std_market")
_feature_query("feat_beta_sector", 4, "beta_sector", "resid_sector", "resid_std_sector")
_feature_query("feat_corr_sector", 4, "corr20", "corr120")


@register("feat_rv10_pct", oracle.feats_sql(f"SELECT symbol, {DAY}, round(rv10_pct, 6) AS rv10_pct FROM feats WHERE rn >= 60"))
def feat_rv10_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.features(spark, sf_dir)
    wanted = features.ready(rows)
    out = wanted.join(features.rank_share(rows, wanted), ["symbol", "rn"], "left")
    return dated(rounded(out.select("symbol", "bar_date", "rv10_pct"), 6, "rv10_pct"))


@register("feat_move_sigmas", oracle.feats_sql(f"""SELECT f.symbol, CAST(f.bar_date AS VARCHAR) AS bar_date, nullif(least(1 + f.rn % 40, least(f.rn, 300) - 1), 0) AS sessions_used,
  round(ln(f.close / nullif(g.close, 0)) / nullif(f.sigma20 * sqrt(least(1 + f.rn % 40, least(f.rn, 300) - 1)), 0), 5) + 0.0 AS move_sigmas
FROM feats f LEFT JOIN feats g ON g.symbol = f.symbol AND g.rn = f.rn - least(1 + f.rn % 40, least(f.rn, 300) - 1)"""))
def feat_move_sigmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The move over 1 to 40 sessions, another number on each day."""
    out = features.moved(registry.features(spark, sf_dir), 1 + F.col("rn") % 40)
    return dated(rounded(out.select("symbol", "bar_date", "sessions_used", "move_sigmas"), 5, "move_sigmas"))


@register("feat_cut_series", oracle.feats_sql(f"SELECT symbol, {DAY}, rn, {round_sql(5, 'rv60', 'atr14', 'high252', 'rvol', 'rvol_past', 'beta_market', 'resid_std_sector', 'corr20', 'corr120')}, worst_confidence, all_confirmed FROM feats"))
def feat_cut_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all days with every series cut into pieces of 150 bars."""
    figures = ["rv60", "atr14", "high252", "rvol", "rvol_past", "beta_market", "resid_std_sector", "corr20", "corr120"]
    out = features.cut_features(registry.bars(spark, sf_dir), length=150)
    return dated(rounded(out.select("symbol", "bar_date", "rn", *figures, "worst_confidence", "all_confirmed"), 5, *figures))


@register("feat_samples", oracle.feats_sql(f"""SELECT symbol, {DAY}, len(a) AS n_returns, round(list_avg(a), 6) AS mean_abs_return, round(v, 6) AS vol30, len(s) AS n_closes, s[1] AS oldest_close FROM (
  SELECT symbol, bar_date, list_filter(list(abs(log_ret)) {oracle._last(90)}, lambda x: x IS NOT NULL) AS a, {oracle._full('stddev_samp(log_ret)', 'log_ret', 30)} AS v, list(close) {oracle._last(20)} AS s FROM feats)"""))
def feat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute returns of 90 days, volatility over 30, and the sparkline of 20 closes, as figures of each."""
    rows = features.sparkline(features.vol_over(features.abs_returns(registry.features(spark, sf_dir)), 30))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    mean = F.try_divide(total("abs_return_sample"), F.nullif(F.size("abs_return_sample"), F.lit(0)))
    out = rows.select("symbol", "bar_date", F.size("abs_return_sample").alias("n_returns"), mean.alias("mean_abs_return"), F.col("vol_over").alias("vol30"), F.size("sparkline").alias("n_closes"), F.col("sparkline")[0].alias("oldest_close"))
    return dated(rounded(out, 6, "mean_abs_return", "vol30"))


@register("feat_benchmark_sigmas", oracle.bars_sql(f"""SELECT {DAY}, CASE WHEN rn < 22 THEN 0 ELSE round(coalesce(r / nullif(stddev_samp(r) OVER (ORDER BY bar_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 0), 5) + 0.0 END::DOUBLE AS sigmas
FROM (SELECT bar_date, row_number() OVER (ORDER BY bar_date) AS rn, ln(close / nullif(lag(close) OVER (ORDER BY bar_date), 0)) AS r FROM adj WHERE kind = 'market')"""))
def feat_benchmark_sigmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    market_bars = features.adjusted(registry.bars(spark, sf_dir)).where("kind = 'market'")
    return dated(rounded(themes.session_sigmas(features.returns(market_bars)).select("bar_date", "sigmas"), 5, "sigmas"))


# ---- statistics over groups --------------------------------------------------------------------


@register("stats_quantiles", oracle.feats_sql("SELECT symbol, " + ", ".join(f"round(quantile_cont(log_ret, {q}), 6) + 0.0 AS {n}" for n, q in (("q00", 0), ("q05", 0.05), ("q30", 0.3), ("q95", 0.95), ("q100", 1))) + " FROM feats GROUP BY symbol"))
def stats_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"q00": -0.5, "q05": 0.05, "q30": 0.3, "q95": 0.95, "q100": 1.5}
    out = registry.features(spark, sf_dir).groupBy("symbol").agg(*[stats.quantile("log_ret", q).alias(n) for n, q in asked.items()])
    return rounded(out, 6, *asked)


@register("stats_winsorized", oracle.feats_sql("""SELECT symbol, count(log_ret) AS n, round(sum(greatest(lo, least(hi, log_ret))), 5) + 0.0 AS total, round(max(greatest(lo, least(hi, log_ret))), 6) AS top
FROM feats JOIN (SELECT symbol AS s, quantile_cont(log_ret, 0.005) AS lo, quantile_cont(log_ret, 0.995) AS hi FROM feats GROUP BY symbol) ON symbol = s WHERE log_ret IS NOT NULL GROUP BY symbol"""))
def stats_winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.winsorized(registry.features(spark, sf_dir), "log_ret", ["symbol"]).groupBy("symbol")
    return rows.agg(F.count("log_ret").alias("n"), (F.round(F.sum("log_ret"), 5) + 0.0).alias("total"), F.round(F.max("log_ret"), 6).alias("top"))


@register("stats_pairwise_correlation", oracle.sql("""SELECT sector, yr, count(DISTINCT a) AS n_series, round(avg(r), 5) + 0.0 AS mean_r FROM (
  SELECT x.sector, x.yr, x.symbol AS a, y.symbol AS b, regr_sxy(x.v, y.v) / nullif(sqrt(regr_sxx(x.v, y.v) * regr_syy(x.v, y.v)), 0) AS r
  FROM s2 x JOIN s2 y ON x.sector = y.sector AND x.yr = y.yr AND x.symbol <> y.symbol AND x.back = y.back WHERE x.back <= x.shortest GROUP BY ALL)
GROUP BY sector, yr""", oracle.BARS, oracle.FEATS, """
s0 AS (SELECT sector, symbol, year(bar_date) AS yr, bar_date, log_ret AS v FROM feats WHERE log_ret IS NOT NULL),
s1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, yr ORDER BY bar_date DESC) AS back, count(*) OVER (PARTITION BY symbol, yr) AS n FROM s0),
s2 AS (SELECT *, min(n) OVER (PARTITION BY sector, yr) AS shortest FROM s1 WHERE n >= 2)"""))
def stats_pairwise_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean correlation of the names of each sector and year."""
    rows = registry.features(spark, sf_dir).withColumn("yr", F.year("bar_date"))
    out = stats.mean_pairwise_correlation(rows, ["sector", "yr"], "symbol", "bar_date", "log_ret").where("n_series > 1")
    return out.select("sector", "yr", "n_series", (F.round("mean_r", 5) + 0.0).alias("mean_r"))


@register("feat_quality", oracle.feats_sql("SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, worst_confidence, all_confirmed FROM feats WHERE rn >= 60"))
def feat_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.ready(registry.features(spark, sf_dir))
    return df.select("symbol", F.col("bar_date").cast("string").alias("bar_date"), "worst_confidence", "all_confirmed")


# ---- detectors and scores ----------------------------------------------------------------------


CAND_COLUMNS = "symbol, sector, CAST(bar_date AS VARCHAR) AS bar_date, position, detector, family, direction, round(magnitude, 4) AS magnitude, round(strength, 4) AS strength"


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.candidates(spark, sf_dir).select(
        "symbol", "sector", F.col("bar_date").cast("string").alias("bar_date"), "position", "detector", "family", "direction",
        F.round("magnitude", 4).alias("magnitude"), F.round("strength", 4).alias("strength"),
    )


register("detect_all", oracle.cands_sql(f"SELECT {CAND_COLUMNS} FROM cands"))(_cands)

for _d in ("move_since_last_seen", "volume_spike", "sector_divergence", "range_break", "vol_regime_shift", "earnings_upcoming", "correlation_break", "quiet_regime"):
    register(f"detect_{_d}", oracle.cands_sql(f"SELECT {CAND_COLUMNS} FROM cands WHERE detector = '{_d}'"))(
        lambda spark, sf_dir, d=_d: _cands(spark, sf_dir).where(F.col("detector") == d)
    )


@register("detect_headlines", oracle.cands_sql(f"SELECT symbol, {DAY}, detector, signal_key, signal_label, round(signal_value, 4) + 0.0 AS signal_value, headline FROM cands"))
def detect_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every candidate says."""
    return dated(rounded(registry.candidates(spark, sf_dir).select("symbol", "bar_date", "detector", "signal_key", "signal_label", "signal_value", "headline"), 4, "signal_value"))


@register("score_events", oracle.scores_sql("SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, detector, direction, round(score, 1) AS score, severity, fingerprint FROM events_scored"))
def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.events(spark, sf_dir).select("symbol", F.col("bar_date").cast("string").alias("bar_date"), "detector", "direction", F.round("score", 1).alias("score"), "severity", "fingerprint")


@register("score_days", oracle.scores_sql("SELECT symbol, sector, CAST(bar_date AS VARCHAR) AS bar_date, n_events, round(score, 1) AS score, severity FROM days"))
def score_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.days(spark, sf_dir).select("symbol", "sector", F.col("bar_date").cast("string").alias("bar_date"), "n_events", F.round("score", 1).alias("score"), "severity")


@register("severity_histogram", oracle.scores_sql("SELECT s.severity, count(d.symbol) AS n_days FROM (VALUES ('NOISE'), ('INFO'), ('WATCH'), ('IMPORTANT'), ('CRITICAL')) s(severity) LEFT JOIN days d ON s.severity = d.severity GROUP BY s.severity"))
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = registry.days(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(days, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n_days"))


@register("score_contributions", oracle.scores_sql("SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, side, place, key, label, family, kind, round(amount, 2) AS amount FROM con", oracle.contributions_sql("context", "con", "symbol, bar_date")))
def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each day has its score: positives, the strongest first, and suppressors, the hardest first."""
    rows = score.score_days(registry.candidates(spark, sf_dir), explain=True)
    ups, downs = score.explained(F.col("contributions"))
    sides = F.array(F.struct(F.lit("positive").alias("side"), ups.alias("c")), F.struct(F.lit("suppressor").alias("side"), downs.alias("c")))
    out = rows.select("symbol", "bar_date", F.inline(sides)).select("symbol", "bar_date", "side", F.posexplode("c").alias("at", "c"))
    return dated(out.select("symbol", "bar_date", "side", (F.col("at") + 1).alias("place"), "c.key", "c.label", "c.family", "c.kind", F.round("c.amount", 2).alias("amount")))


_AGE = "((bar_date - DATE '1970-01-01') % 12)"
_DECAY = f"CASE WHEN {_AGE} <= 0 OR detector = 'earnings_upcoming' THEN 1 ELSE greatest(0.35, pow(2, -{_AGE} / CASE detector WHEN 'move_since_last_seen' THEN 2.0 WHEN 'volume_spike' THEN 2.0 WHEN 'sector_divergence' THEN 3.0 WHEN 'range_break' THEN 4.0 WHEN 'vol_regime_shift' THEN 10.0 ELSE 3.0 END::DOUBLE)) END"


@register("score_aged", oracle.scores_sql(f"SELECT symbol, {DAY}, detector, round(score, 1) AS score, severity_rank FROM aged", oracle.score_sql("alone", "aged", detector="detector", age=_AGE, extra=f"{oracle._mult(_DECAY)} * CASE WHEN day(bar_date) % 5 = 0 THEN 0.9 ELSE 1 END")))
def score_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored with an age of 0 to 11 trading days and a macro event on every fifth day of the month."""
    age, macro = F.datediff("bar_date", F.lit("1970-01-01")) % 12, F.dayofmonth("bar_date") % 5 == 0
    rows = score.score_events(registry.candidates(spark, sf_dir), age=age, macro=macro)
    return dated(rows.select("symbol", "bar_date", "detector", F.round("score", 1).alias("score"), "severity_rank"))


@register("score_similar", oracle.scores_sql(f"""SELECT symbol, {DAY}, detector, coalesce(lag(direction) OVER e = direction AND abs(score - lag(score) OVER e) < 15, false) AS says_the_same
FROM events_scored WINDOW e AS (PARTITION BY symbol, detector ORDER BY bar_date)"""))
def score_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event says the same as the one before it of its name and detector."""
    order = Window.partitionBy("symbol", "detector").orderBy("bar_date")
    before = [F.lag(c).over(order) for c in ("detector", "direction", "score")]
    same = score.materially_similar(*before, F.col("detector"), F.col("direction"), F.col("score"))
    return dated(registry.events(spark, sf_dir).select("symbol", "bar_date", "detector", F.coalesce(same, F.lit(False)).alias("says_the_same")))


# ---- themes ------------------------------------------------------------------------------------

_S = oracle._last(91)
SERIES = f"""
own0 AS (SELECT symbol, bar_date, close, row_number() {oracle.W} AS rn, lag(close) {oracle.W} AS pc, lag(bar_date) {oracle.W} AS pd FROM adj WHERE kind = 'instrument'),
own1 AS (
  SELECT o.*, ln(o.close / nullif(pc, 0)) AS lr, ln(m1.close / nullif(m0.close, 0)) AS x FROM own0 o
  LEFT JOIN adj m1 ON m1.kind = 'market' AND m1.bar_date = o.bar_date LEFT JOIN adj m0 ON m0.kind = 'market' AND m0.bar_date = o.pd
), own2 AS (
  SELECT *, CASE WHEN x IS NOT NULL THEN lr END AS y FROM own1
), own3 AS (
  SELECT *, list_filter(list(CASE WHEN y IS NOT NULL THEN {{'y': y, 'x': x}} END) {_S}, lambda p: p IS NOT NULL) AS pairs, regr_count(y, x) {_S} AS n, regr_sxx(y, x) {_S} AS sxx, regr_sxy(y, x) {_S} AS sxy,
    regr_avgx(y, x) {_S} AS gx, regr_avgy(y, x) {_S} AS gy, stddev_samp(lr) {oracle._last(20)} AS sd20 FROM own2
), series91 AS (
  SELECT symbol, bar_date, close / nullif(pc, 0) - 1 AS ret, coalesce(lr / nullif(sd20, 0), 0) AS move_sigmas, sxy / nullif(sxx, 0) AS beta,
    list_transform(pairs, lambda p: p.y - (gy + sxy / sxx * (p.x - gx))) AS residuals, sxy / nullif(sxx, 0) * pairs[len(pairs)].x AS explained
  FROM own3 WHERE rn >= 92 AND n >= 20 AND sxx > 0
), mem AS (
  SELECT d.symbol, d.sector, d.bar_date, d.score, s.ret, s.move_sigmas, s.residuals, s.explained, CASE WHEN s.ret < 0 THEN -1 ELSE 1 END AS direction
  FROM days d JOIN series91 s ON d.symbol = s.symbol AND d.bar_date = s.bar_date WHERE d.severity_rank >= 2 AND d.sector IS NOT NULL AND abs(s.move_sigmas) >= 1
)"""


@register("theme_members", oracle.scores_sql("SELECT symbol, sector, CAST(bar_date AS VARCHAR) AS bar_date, direction, round(score, 1) AS score, round(move_sigmas, 4) AS move_sigmas, round(explained, 4) + 0.0 AS explained, len(residuals) AS n_residuals FROM mem", SERIES))
def theme_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = registry.members(spark, sf_dir)
    return out.select("symbol", "sector", F.col("bar_date").cast("string").alias("bar_date"), "direction", F.round("score", 1).alias("score"), F.round("move_sigmas", 4).alias("move_sigmas"), (F.round("explained", 4) + 0.0).alias("explained"), F.size("residuals").alias("n_residuals"))


def themes_sql(least: int = 3, window: int = 1) -> str:
    """Subqueries up to ``themes``: pairs of members are compared one by one."""
    timing = "1.0::DOUBLE" if window == 1 else f"greatest(0, least(1, 1 - spread / {window - 1}::DOUBLE))"
    return f"""
wmem AS (SELECT *, bar_date - CAST((bar_date - DATE '1970-01-01') % {window} AS INTEGER) AS window_start FROM mem),
grp AS (SELECT *, count(*) OVER g AS size_of, min(CASE WHEN len(residuals) >= 20 THEN len(residuals) END) OVER g AS shortest, row_number() OVER (PARTITION BY window_start, sector, direction ORDER BY symbol, bar_date) AS nth
  FROM wmem WINDOW g AS (PARTITION BY window_start, sector, direction)),
big AS (SELECT * FROM grp WHERE size_of >= {least}),
pr AS (
  SELECT a.window_start, a.sector, a.direction, a.nth, b.nth AS other, unnest(a.residuals[-a.shortest:]) AS ra, unnest(b.residuals[-a.shortest:]) AS rb
  FROM big a JOIN big b ON a.window_start = b.window_start AND a.sector = b.sector AND a.direction = b.direction AND a.nth < b.nth WHERE len(a.residuals) >= 20 AND len(b.residuals) >= 20
), prc AS (
  SELECT window_start, sector, direction, nth, other, regr_sxy(ra, rb) / nullif(sqrt(regr_sxx(ra, rb) * regr_syy(ra, rb)), 0) AS r FROM pr GROUP BY ALL
), coh AS (SELECT window_start, sector, direction, avg(r) AS mean_r FROM prc GROUP BY ALL),
th0 AS (
  SELECT window_start, sector, direction, count(*) AS n_members, avg(abs(ret)) AS mean_ret, avg(abs(explained)) AS mean_explained, max(bar_date) - min(bar_date) AS spread,
    string_agg(symbol, ',' ORDER BY score DESC, symbol, bar_date) AS members FROM big GROUP BY ALL
), th1 AS (
  SELECT t.*, coalesce(greatest(0, least(1, mean_r)), 0) AS coh, {timing} AS tim, least(1, n_members / 5.0) AS sz, greatest(0, least(1, 1 - CASE WHEN mean_ret > 1e-9 THEN mean_explained / mean_ret ELSE 1 END)) AS dis
  FROM th0 t LEFT JOIN coh c ON t.window_start = c.window_start AND t.sector = c.sector AND t.direction = c.direction
), groups AS (
  SELECT window_start, window_start + {window - 1} AS window_end, sector, direction, n_members, members, mean_ret, floor(coh * 1000 + 0.5) / 1000 AS cohesion, floor(tim * 1000 + 0.5) / 1000 AS timing, floor(sz * 1000 + 0.5) / 1000 AS size,
    floor(dis * 1000 + 0.5) / 1000 AS distinctness, floor(100 * (0.35 * coh + 0.2 * tim + 0.2 * sz + 0.25 * dis)::DOUBLE * 10 + 0.5) / 10 AS confidence FROM th1
), themes AS (SELECT * FROM groups WHERE distinctness >= 0.35 AND confidence >= 45)"""


_PARTS = "sector, direction, n_members, members, cohesion, timing::DOUBLE AS timing, size::DOUBLE AS size, distinctness, confidence"
_SPAN = "CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end"
PARTS = ["sector", "direction", "n_members", "members", "cohesion", "timing", "size", "distinctness", "confidence"]


def _themes(df: DataFrame, *columns: str) -> DataFrame:
    return dated(df, "window_start", "window_end").select("window_start", "window_end", *columns)


@register("themes", oracle.scores_sql(f"SELECT {_SPAN}, {_PARTS} FROM themes", SERIES, themes_sql()))
def themes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _themes(themes.themes(registry.members(spark, sf_dir)), *PARTS)


@register("theme_groups", oracle.scores_sql(f"SELECT {_SPAN}, {_PARTS} FROM groups", SERIES, themes_sql(2)))
def theme_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of every group of two or more, before the gates."""
    return _themes(themes.themes(registry.members(spark, sf_dir), gates=False, least=2), *PARTS)


@register("themes_multi_day", oracle.scores_sql(f"SELECT {_SPAN}, {_PARTS} FROM groups", SERIES, themes_sql(3, 5)))
def themes_multi_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three or more over windows of five days, whose timing tells how spread their days are."""
    return _themes(themes.themes(registry.members(spark, sf_dir), gates=False, window_days=5), *PARTS)


@register("theme_texts", oracle.scores_sql(f"""SELECT {_SPAN}, sector, direction, CASE WHEN confidence >= 75 THEN 'High' WHEN confidence >= 50 THEN 'Medium' ELSE 'Low' END AS band,
  concat_ws('; ', CASE WHEN timing >= 0.8 THEN 'at once' ELSE 'by and by' END, CASE WHEN cohesion >= 0.5 THEN 'correlated' END,
    CASE WHEN distinctness >= 0.6 THEN 'apart from the market' WHEN distinctness <= 0.35 THEN 'with the market' END,
    CASE WHEN mean_ret > 0 THEN 'mean size ' || {oracle._fixed('(mean_ret * 100)', 1)} || '%' END) AS characteristics,
  sector || CASE WHEN direction < 0 THEN ' down: ' ELSE ' up: ' END || n_members || ' members, first ' || split_part(members, ',', 1)
    || CASE WHEN distinctness >= 0.6 THEN ', apart from the market' ELSE '' END AS summary FROM groups""", SERIES, themes_sql(3, 5)))
def theme_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.themes(registry.members(spark, sf_dir), gates=False, window_days=5)
    return _themes(out.withColumn("characteristics", F.array_join("characteristics", "; ")), "sector", "direction", "band", "characteristics", "summary")


@register("theme_events", oracle.scores_sql("""SELECT e.symbol, CAST(e.bar_date AS VARCHAR) AS bar_date, e.detector, e.fingerprint, t.sector AS theme_sector, t.direction AS theme_direction, t.confidence AS theme_confidence
FROM events_scored e LEFT JOIN (SELECT m.symbol, m.bar_date, t.* FROM mem m JOIN themes t ON m.bar_date = t.window_start AND m.sector = t.sector AND m.direction = t.direction) t ON e.symbol = t.symbol AND e.bar_date = t.bar_date""", SERIES, themes_sql()))
def theme_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the theme it belongs to, if any."""
    out = themes.linked_events(registry.events(spark, sf_dir), registry.links(spark, sf_dir))
    return dated(out.select("symbol", "bar_date", "detector", "fingerprint", *[F.col(f"theme.{c}").alias(f"theme_{c}") for c in ("sector", "direction", "confidence")]))


# ---- calibration and replay ----------------------------------------------------------


@register("calibration_detectors", oracle.scores_sql("""SELECT e.detector, count(*) AS fired, count(*) FILTER (d.severity_rank >= 2) AS on_surfaced_day
FROM events_scored e JOIN days d ON e.symbol = d.symbol AND e.bar_date = d.bar_date GROUP BY e.detector"""))
def calibration_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = registry.candidates(spark, sf_dir)
    days = registry.days(spark, sf_dir).select("symbol", "bar_date", F.col("severity_rank").alias("day_rank"))
    return events.join(days, ["symbol", "bar_date"]).groupBy("detector").agg(F.count("*").alias("fired"), F.count_if(F.col("day_rank") >= 2).alias("on_surfaced_day"))


@register("calibration_rate", oracle.scores_sql("""SELECT symbol, count(*) FILTER (severity_rank >= 2) AS surfaced, round(count(*) FILTER (severity_rank >= 2) / ((max(bar_date) - min(bar_date) + 1) / 30.44), 8) AS per_month FROM days GROUP BY symbol"""))
def calibration_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = registry.days(spark, sf_dir)
    months = (F.datediff(F.max("bar_date"), F.min("bar_date")) + 1) / 30.44
    n = F.count_if(F.col("severity_rank") >= 2)
    return days.groupBy("symbol").agg(n.alias("surfaced"), F.round(n / months, 8).alias("per_month"))


@register("calibration_follow_through", oracle.scores_sql("""SELECT surfaced, count(*) AS n, count(*) FILTER (moved) AS n_moved, round(avg(moved::INT), 6) AS share FROM (
  SELECT coalesce(d.severity_rank >= 2, false) AS surfaced, abs(ln(f.nxt / nullif(f.close, 0))) / nullif(f.sigma20 * sqrt(3), 0) >= 1.5 AS moved
  FROM (SELECT *, lead(close, 3) OVER (PARTITION BY symbol ORDER BY bar_date) AS nxt FROM feats) f LEFT JOIN days d ON f.symbol = d.symbol AND f.bar_date = d.bar_date
  WHERE f.rn >= 60 AND f.nxt IS NOT NULL AND f.sigma20 > 0) GROUP BY surfaced"""))
def calibration_follow_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = registry.features(spark, sf_dir).withColumn("nxt", F.lead("close", 3).over(features.series()))
    own = own.where("rn >= 60 and nxt is not null and sigma20 > 0").select("symbol", "bar_date", "close", "nxt", "sigma20")
    days = registry.days(spark, sf_dir).select("symbol", "bar_date", "severity_rank")
    moved = F.abs(F.ln(F.col("nxt") / F.col("close"))) / (F.col("sigma20") * F.sqrt(F.lit(3.0))) >= 1.5
    rows = own.join(days, ["symbol", "bar_date"], "left").select(F.coalesce(F.col("severity_rank") >= 2, F.lit(False)).alias("surfaced"), moved.alias("moved"))
    return rows.groupBy("surfaced").agg(F.count("*").alias("n"), F.count_if("moved").alias("n_moved"), F.round(F.avg(F.col("moved").cast("int")), 6).alias("share"))


@register("replay_top", oracle.scores_sql("""SELECT CAST(bar_date AS VARCHAR) AS bar_date, symbol, place FROM (
  SELECT bar_date, symbol, row_number() OVER (PARTITION BY bar_date ORDER BY floor(raw_score * 10 + 0.5) DESC, symbol) AS place FROM days WHERE severity_rank >= 2) WHERE place <= 5"""))
def replay_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest names of every replayed day."""
    order = Window.partitionBy("bar_date").orderBy(F.floor(F.col("raw_score") * 10 + 0.5).desc(), "symbol")
    days = registry.days(spark, sf_dir).where("severity_rank >= 2").withColumn("place", F.row_number().over(order))
    return days.where("place <= 5").select(F.col("bar_date").cast("string").alias("bar_date"), "symbol", "place")


@register("calibration_summary", oracle.scores_sql("""SELECT round(avg(per_month), 5) AS per_name_month, round(avg(per_month) * 17 / 8.7, 5) AS items_per_brief, round(max(shown_share), 6) AS shown_share, round(max(every_share), 6) AS every_share,
  round(max(shown_share) / max(every_share), 5) AS lift
FROM (SELECT count(*) FILTER (severity_rank >= 2) / ((max(bar_date) - min(bar_date) + 1) / 30.44) AS per_month FROM days GROUP BY symbol), (
  SELECT avg(moved::INT) FILTER (surfaced) AS shown_share, avg(moved::INT) AS every_share FROM (
    SELECT coalesce(d.severity_rank >= 2, false) AS surfaced, abs(ln(f.nxt / nullif(f.close, 0))) / nullif(f.sigma20 * sqrt(3), 0) >= 1.5 AS moved
    FROM (SELECT *, lead(close, 3) OVER (PARTITION BY symbol ORDER BY bar_date) AS nxt FROM feats) f LEFT JOIN days d ON f.symbol = d.symbol AND f.bar_date = d.bar_date
    WHERE f.rn >= 60 AND f.nxt IS NOT NULL AND f.sigma20 > 0))"""))
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The macro average of surfaced days a name and month, items of a typical brief (17 names, 8.7 visits a month), and how
    much more often a surfaced day is followed by a move than any session is."""
    rates = calibration_rate(spark, sf_dir).agg(F.avg("per_month").alias("rate"))
    groups = calibration_follow_through(spark, sf_dir)
    shares = groups.agg((F.sum(F.when(F.col("surfaced"), F.col("n_moved"))) / F.sum(F.when(F.col("surfaced"), F.col("n")))).alias("shown"), (F.sum("n_moved") / F.sum("n")).alias("every"))
    both = rates.withColumn("k", F.lit(1)).join(shares.withColumn("k", F.lit(1)), "k")
    return both.select(
        F.round("rate", 5).alias("per_name_month"), F.round(F.col("rate") * 17 / 8.7, 5).alias("items_per_brief"), F.round("shown", 6).alias("shown_share"), F.round("every", 6).alias("every_share"),
        F.round(F.col("shown") / F.col("every"), 5).alias("lift"),
    )


# the other parts register their queries on import
from tidewatch.plans import briefs, ingestion, recomputation  # noqa: E402, F401
