"""Replay of a period, day by day: what would have been shown, from data up to each day only.

Every feature looks back only, so the days of a period are those of the engine's own run; nothing is computed again for a day. Each
session of the period gives a row, also one on which nothing happened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import narrative, score, themes
from tidewatch.operators.features import adjusted, last_rows, returns, sparkline

SHOWN = 5


def items(days: DataFrame, events: DataFrame, bars: DataFrame) -> DataFrame:
    """Surfaced days as items: place of the day (whole points, then name), the headline of the lead event, what speaks for and against, the day's return,
    and the last 20 closes. ``days`` hold contributions; a name's first bar cannot be an item."""
    ups, downs = score.explained(F.col("contributions"))
    rows = days.where("severity_rank >= 2").withColumns({"positives": ups, "suppressors": downs, "attention": F.floor(F.col("score") + 0.5).cast("int")})
    rows = rows.withColumn("top", F.get(F.filter("positives", lambda c: c["kind"] == "additive"), F.lit(0)))
    best = F.struct("score", -F.col("position"))
    told = events.select("symbol", "bar_date", "score", "position", "headline", "signal_key", "signal_label").join(rows.select("symbol", "bar_date", "top"), ["symbol", "bar_date"])
    owned = (F.col("signal_key") == F.col("top.key")) & (F.col("signal_label") == F.col("top.label"))
    leads = told.groupBy("symbol", "bar_date").agg(F.coalesce(F.max_by("headline", F.when(owned, best)), F.max_by("headline", best)).alias("headline"))
    prices = sparkline(returns(adjusted(bars.where("kind = 'instrument'")))).where("rn > 1").select("symbol", "bar_date", "ret1d", "sparkline")
    out = rows.join(leads, ["symbol", "bar_date"]).join(prices, ["symbol", "bar_date"])
    order = Window.partitionBy("bar_date").orderBy(F.col("attention").desc(), "symbol")
    return out.withColumn("place", F.row_number().over(order)).select("bar_date", "place", "symbol", "sector", "attention", "severity", "headline", "positives", "suppressors", F.col("ret1d").alias("return_pct"), "sparkline")


def steps(found: DataFrame, members: DataFrame, bars: DataFrame, names: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each session from ``first`` to ``last``: items (the first ``SHOWN``), themes, rule and text of the narrative, return and sigmas of the
    market, and how many of the replayed ``names`` (symbol) were quiet. ``found`` are the :func:`items` of these names, ``members`` their surfaced days."""
    size = names.agg(F.count_distinct("symbol")).scalar()
    inside = F.col("bar_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    market = themes.session_sigmas(returns(adjusted(bars.where("kind = 'market'"))))
    market = market.where(inside).select("bar_date", F.coalesce("ret1d", F.lit(0.0)).alias("market_return"), F.col("sigmas").alias("market_sigmas"))
    found, members = (df.where(inside).join(names.select("symbol").distinct(), "symbol", "left_semi") for df in (found, members))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("bar_date").orderBy("place")))
    item = F.struct("place", "symbol", "sector", "attention", "severity", "headline", "positives", "suppressors", "return_pct", "sparkline")
    listed = found.groupBy("bar_date").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.when(F.col("place") <= SHOWN, item))).alias("items"))
    groups = themes.themes(members).withColumn("by", F.struct((-F.col("confidence")).alias("c"), "sector", "direction", "n_members", "members", "cohesion", "timing", "size", "distinctness", "summary"))
    up, down = F.col("direction") == 1, F.col("direction") == -1
    reached = groups.groupBy(F.col("window_start").alias("bar_date")).agg(
        F.array_sort(F.collect_list("by")).alias("themes"), F.count_if(up).alias("up"), F.count_if(down).alias("down"),
        *[F.min(F.when(c, F.col("by"))).alias(n) for n, c in (("first", F.lit(True)), ("first_up", up), ("first_down", down))],
    )

    def theme(name: str):
        c = F.col(name)
        return F.when(c.isNotNull(), F.struct(c["sector"].alias("sector"), c["direction"].alias("direction"), (-c["c"]).alias("confidence"), c["n_members"].alias("n_members")))

    days = market.select("bar_date").union(listed.select("bar_date")).distinct()  # sessions, and days of items that the market lacks
    out = days.join(market, "bar_date", "left").join(listed, "bar_date", "left").join(reached, "bar_date", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_items", "up", "down")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("market_return", "market_sigmas")})
    out = out.withColumns({"theme": theme("first"), "up_theme": theme("first_up"), "down_theme": theme("first_down"), "n_watched": size, "n_snoozed": F.lit(0), "n_surfaced": F.col("n_items"), "n_shown": F.least("n_items", F.lit(SHOWN))})
    out = out.withColumns({
        "top_share": F.coalesce(F.size(F.filter("items", lambda i: i["sector"] == F.col("theme.sector"))), F.lit(0)),
        "breadth": F.coalesce(F.try_divide(F.col("n_items").cast("double"), F.col("n_watched")), F.lit(0.0)),
    })
    c = F.col
    out = out.withColumn("rule", narrative.rule(c("n_items"), c("up"), c("down"), c("top_share"), c("theme.direction"), c("market_sigmas"), c("market_return"), c("breadth"), c("n_watched")))
    return out.withColumns({"text": narrative.text(c("rule")), "quiet_count": c("n_watched") - c("n_items")}).select(
        "bar_date", "n_items", "quiet_count", "items", "themes", "rule", "text", "market_return", "market_sigmas"
    )
