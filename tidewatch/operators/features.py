"""Rolling features of every instrument and day, from frames that end at the day itself.

All own-series frames share one window order, so Spark sorts each symbol once. A proxy has one row a day; its close
joins the own row by date, and the frames of a regression run over the rows that have one, still in the partition of
the symbol: no series is joined with itself. Prices are adjusted closes, except for highs, lows and volume.
No frame looks ahead, which makes the features point-in-time by construction.

Samples of past values (:func:`trailing`) are gathered only for rows that ask for them: each value is packed once into
a block, and a row meets the two blocks that its sample can lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import correlation, safe_div

MIN_HISTORY = 60


def series():
    """The order of each symbol's days (a function: windows need a running session)."""
    return Window.partitionBy("symbol").orderBy("bar_date")


def last_rows(n: int):
    return series().rowsBetween(-(n - 1), 0)


def rows_before(n: int):
    return series().rowsBetween(-n, -1)


def full(value: Column, guard: Column, n: int) -> Column:
    """``value`` over the last n rows, null until n of ``guard`` are there."""
    return F.when(F.count(guard).over(last_rows(n)) == n, value.over(last_rows(n)))


def returns(bars: DataFrame) -> DataFrame:
    """Adds rn, prev_close, ret1d, log_ret and true_range; ``rn_before``, where the bars have it, tells how many bars of the series were left out before."""
    prev = F.lag("close").over(series())
    place = F.row_number().over(series())
    if "rn_before" in bars.columns:
        place = (place + F.coalesce("rn_before", F.lit(0))).cast("int")
    out = bars.withColumn("rn", place).withColumn("prev_close", prev)
    moved = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))
    return out.withColumns({
        "ret1d": safe_div(F.col("close"), F.col("prev_close")) - 1,
        "log_ret": F.ln(safe_div(F.col("close"), F.col("prev_close"))),
        "true_range": F.when(F.col("prev_close").isNotNull(), moved),
    })


def own_features(bars: DataFrame) -> DataFrame:
    """Features that need the instrument's own series only."""
    lr, close = F.col("log_ret"), F.col("close")
    out = returns(bars)
    out = out.withColumn("sigma20", full(F.stddev_samp(lr), lr, 20))
    out = out.withColumns({
        "rv10": F.coalesce(full(F.stddev_samp(lr), lr, 10), "sigma20"),
        "rv60": F.coalesce(full(F.stddev_samp(lr), lr, 60), "sigma20"),
        "atr14": full(F.avg("true_range"), F.col("true_range"), 14),
        "sma20": F.coalesce(full(F.avg(close), close, 20), close),
        "sma50": F.coalesce(full(F.avg(close), close, 50), close),
        **{f"high{n}": F.max("high").over(rows_before(n)) for n in (20, 60, 252)},
        **{f"low{n}": F.min("low").over(rows_before(n)) for n in (20, 60, 252)},
        "median_volume20": F.percentile("volume", F.lit(0.5)).over(last_rows(20)),
        "volume_before20": F.percentile("volume", F.lit(0.5)).over(rows_before(20)),
        "worst_confidence": F.min("confidence").over(last_rows(90)),
        "all_confirmed": F.bool_and("confirmed").over(last_rows(90)),
    })
    out = out.withColumn("rvol", F.coalesce(safe_div(F.col("volume").cast("double"), F.col("median_volume20")), F.lit(1.0)))
    past = F.when(F.col("rn") >= 21, safe_div(F.col("volume").cast("double"), F.col("volume_before20")))
    return out.withColumn("rvol_past", past)


def trailing(rows: DataFrame, wanted: DataFrame, value: Column, n: int) -> DataFrame:
    """(symbol, rn, sample): for each (symbol, rn) of ``wanted`` the values of the last n rows, nulls left out."""
    packed = rows.select("symbol", "rn", value.alias("v")).where("v is not null").groupBy("symbol", F.floor(F.col("rn") / n).alias("block")).agg(F.collect_list(F.struct("rn", "v")).alias("packed"))
    at = F.floor(F.col("rn") / n)
    asked = wanted.select("symbol", "rn", F.explode(F.array(at - 1, at)).alias("block"))
    mine = F.filter("packed", lambda p: (p["rn"] <= F.col("rn")) & (p["rn"] > F.col("rn") - n))
    met = asked.join(packed, ["symbol", "block"]).select("symbol", "rn", F.transform(mine, lambda p: p["v"]).alias("part"))
    return met.groupBy("symbol", "rn").agg(F.flatten(F.collect_list("part")).alias("sample"))


def rank_share(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(symbol, rn, rv10_pct): the share of the last 252 volatilities, from the twelfth bar on, that today's does not
    fall below; null before the fortieth bar or with fewer than 30 of them."""
    met = wanted.select("symbol", "rn", "rv10").join(trailing(rows, wanted, F.when(F.col("rn") >= 12, F.col("rv10")), 252), ["symbol", "rn"])
    size = F.size("sample")
    share = F.size(F.filter("sample", lambda v: v <= F.col("rv10"))) / size
    return met.select("symbol", "rn", F.when((F.col("rn") >= 40) & (size >= 30), share).alias("rv10_pct"))


def moved_from(rows: DataFrame, closes: DataFrame, sessions: Column) -> DataFrame:
    """Adds sessions_used, from_close and move_sigmas: the move of each row over its own number of sessions, in
    deviations of such a stretch. The close is met by position in ``closes``, so each row may look back its own way.

    At most one session less than there are bars, of which 300 count. Null without a number of sessions of 1 or more.
    """
    n = F.least(sessions, F.least(F.col("rn"), F.lit(300)) - 1)
    out = rows.withColumn("sessions_used", F.when((sessions >= 1) & (n >= 1), n).cast("int")).withColumn("__back", F.col("rn") - F.col("sessions_used"))
    past = closes.select("symbol", F.col("rn").alias("__back"), F.col("close").alias("from_close"))
    out = out.join(past, ["symbol", "__back"], "left").drop("__back")
    return out.withColumn("move_sigmas", safe_div(F.ln(safe_div(F.col("close"), F.col("from_close"))), F.col("sigma20") * F.sqrt(F.col("sessions_used").cast("double"))))


def moved(feats: DataFrame, sessions: Column) -> DataFrame:
    """:func:`moved_from` over the rows' own closes."""
    return moved_from(feats, feats, sessions)


def abs_returns(rows: DataFrame, n: int = 90) -> DataFrame:
    """Adds abs_return_sample: the absolute log returns of the last n bars, as many as there are."""
    return rows.withColumn("abs_return_sample", F.collect_list(F.abs("log_ret")).over(last_rows(n)))


def vol_over(rows: DataFrame, n: int) -> DataFrame:
    """Adds vol_over: the deviation of the last n log returns, null until there are so many."""
    return rows.withColumn("vol_over", full(F.stddev_samp("log_ret"), F.col("log_ret"), n))


def sparkline(rows: DataFrame, n: int = 20) -> DataFrame:
    """Adds sparkline: the last n closes."""
    return rows.withColumn("sparkline", F.collect_list("close").over(last_rows(n)))


def _paired(flag: str, n: int):
    """The last n rows among those of the symbol that have the proxy."""
    return Window.partitionBy("symbol", flag).orderBy("bar_date").rowsBetween(-(n - 1), 0)


def regressed(rows: DataFrame, prefix: str) -> DataFrame:
    """Adds beta_, resid_ and resid_std_ to rows with ``<prefix>_close``: slope, today's residual and its deviation
    over the last 90 paired returns, 20 at least; null on days that the proxy lacks."""
    flag, y, x = f"__has_{prefix}", F.col(f"__y_{prefix}"), F.col(f"__x_{prefix}")
    order = Window.partitionBy("symbol", flag).orderBy("bar_date")
    out = rows.withColumn(flag, F.col(f"{prefix}_close").isNotNull())
    out = out.withColumns({
        f"__y_{prefix}": F.when(F.col(flag), F.ln(safe_div(F.col("close"), F.lag("close").over(order)))),
        f"__x_{prefix}": F.when(F.col(flag), F.ln(safe_div(F.col(f"{prefix}_close"), F.lag(f"{prefix}_close").over(order)))),
    })
    frame = _paired(flag, 90)
    figures = {"n": F.regr_count, "sxx": F.regr_sxx, "syy": F.regr_syy, "sxy": F.regr_sxy, "mx": F.regr_avgx, "my": F.regr_avgy}
    out = out.withColumns({f"__{k}": f(y, x).over(frame) for k, f in figures.items()})
    c = {k: F.col(f"__{k}") for k in figures}
    out = out.withColumn("__beta", F.when(c["n"] >= 20, safe_div(c["sxy"], c["sxx"])))
    spread = F.sqrt(F.greatest(safe_div(c["syy"] - F.col("__beta") * c["sxy"], c["n"] - 1), F.lit(0.0)))
    return out.withColumns({
        f"beta_{prefix}": F.col("__beta"),
        f"resid_{prefix}": y - (c["my"] + F.col("__beta") * (x - c["mx"])),
        f"resid_std_{prefix}": F.when(F.col("__beta").isNotNull(), spread),
    }).drop("__beta", *[f"__{k}" for k in figures])


def correlated(rows: DataFrame, prefix: str, *lengths: int) -> DataFrame:
    """Adds corr<n>: the correlation with the proxy over so many paired returns, carried over days that the proxy lacks."""
    flag, y, x = f"__has_{prefix}", F.col(f"__y_{prefix}"), F.col(f"__x_{prefix}")
    carried = series().rowsBetween(Window.unboundedPreceding, 0)
    for n in lengths:
        frame = _paired(flag, n)
        value = correlation(F.regr_sxy(y, x).over(frame), F.regr_sxx(y, x).over(frame), F.regr_syy(y, x).over(frame))
        rows = rows.withColumn(f"__corr{n}", F.when(F.col(flag) & (F.regr_count(y, x).over(frame) == n), value))
    return rows.withColumns({f"corr{n}": F.last(f"__corr{n}", ignorenulls=True).over(carried) for n in lengths}).drop(*[f"__corr{n}" for n in lengths])


def adjusted(bars: DataFrame) -> DataFrame:
    """Bars whose close is the adjusted one."""
    return bars.withColumn("close", F.col("close_adj")).drop("close_adj")


def features(bars: DataFrame) -> DataFrame:
    """One row for each instrument and day of its series, short histories included (see ``ready``)."""
    bars = adjusted(bars)
    market = bars.where("kind = 'market'").select("bar_date", F.col("close").alias("market_close"))
    sector = bars.where("kind = 'sector'").select("sector", "bar_date", F.col("close").alias("sector_close"))
    rows = bars.where("kind = 'instrument'").join(market, "bar_date", "left").join(sector, ["sector", "bar_date"], "left")
    out = regressed(regressed(own_features(rows), "market"), "sector")
    out = correlated(out, "sector", 20, 120)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def placed(bars: DataFrame) -> DataFrame:
    """Adds __rn, the place of each bar in its series: counted within a year, behind the counts of the years before, so no task sees a whole series."""
    rows = bars.withColumn("__year", F.year("bar_date"))
    years = rows.groupBy("symbol", "__year").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("symbol").orderBy("__year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.select("symbol", "__year", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("symbol", "__year").orderBy("bar_date"))
    return rows.withColumn("__in", inside).join(years, ["symbol", "__year"]).withColumn("__rn", F.col("__in") + F.col("__before")).drop("__year", "__in", "__before")


def cut_features(bars: DataFrame, length: int = 2000, halo: int = 400) -> DataFrame:
    """:func:`features` with every series cut into pieces of ``length`` bars, each computed with the ``halo`` bars before it, so that one symbol
    keeps many tasks busy. The longest frame is 252 bars; correlations reach back 121 bars that the proxy has too. What is carried over
    days that the proxy lacks comes from the ends of the pieces before: one row a piece."""
    if halo < 253:
        raise ValueError("the halo must hold the longest frame, 252 bars and one before")
    own = placed(bars.where("kind = 'instrument'"))
    piece = F.floor((F.col("__rn") - 1) / length)
    copies = own.withColumns({"__own": piece, "__piece": F.explode(F.sequence(piece, F.floor((F.col("__rn") + halo - 1) / length)))})
    first = F.greatest(F.col("__piece") * length - halo, F.lit(0))
    named = copies.select(
        *[c for c in bars.columns if c != "symbol"], F.concat_ws("\u0001", "symbol", F.col("__piece").cast("string")).alias("symbol"), first.alias("rn_before"), (F.col("__own") == F.col("__piece")).alias("is_own"), F.col("symbol").alias("whole"), F.col("__piece").alias("piece")
    )
    found = features(named.unionByName(bars.where("kind <> 'instrument'"), allowMissingColumns=True)).where("is_own")
    carried = {f"corr{n}": F.max_by(f"corr{n}", F.when(F.col(f"corr{n}").isNotNull(), F.col("rn"))) for n in (20, 120)}
    ends = found.groupBy("whole", "piece").agg(*[v.alias(f"end_{k}") for k, v in carried.items()])
    earlier = Window.partitionBy("whole").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("whole", "piece", *[F.last(f"end_{k}", ignorenulls=True).over(earlier).alias(f"seed_{k}") for k in carried])
    out = found.join(ends, ["whole", "piece"]).withColumns({k: F.coalesce(k, f"seed_{k}") for k in carried})
    return out.withColumn("symbol", F.col("whole")).drop("whole", "piece", "is_own", "rn_before", *[f"seed_{k}" for k in carried])


def ready(feats: DataFrame) -> DataFrame:
    """Days with enough history to judge; windows come first, so this never shortens a frame."""
    return feats.where(F.col("rn") >= MIN_HISTORY)
