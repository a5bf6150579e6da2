"""Provider bars: parsing, split adjustment, validation, reconciliation, and insert-if-absent storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_TOLERANCE = 0.003
VOLUME_TOLERANCE = 0.25
WORST_CONFLICT = 0.1
MAX_MOVE = 0.6
MAX_GAP_DAYS = 4
PRICES = ["open", "high", "low", "close"]
FIELDS = [*PRICES, "close_adj"]
KEY = ["symbol", "source_id"]


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _checked(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with an array ``usable`` of one value or more, the bodies that gave none with their reason)."""
    judged = rows.withColumn("reason", F.coalesce(error, F.when(F.size("usable") == 0, "no usable rows in response")))
    letters = judged.where("reason is not null").select("source_id", "symbol", F.col("__body").alias("payload"), "reason")
    return judged.where("reason is null"), letters


#: Numbers as providers write them, also inside strings.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A number given as text: null counts as none, the empty text as 0, all that is not written as a number as not a number."""
    return F.when(text.isNull(), F.lit(None).cast("double")).when(F.trim(text) == "", 0.0).when(text.rlike(_NUMBER), text.try_cast("double")).otherwise(F.lit(float("nan")))


def iso_date(text: Column) -> Column:
    """The day of a text that begins with YYYY-MM-DD; null (a malformed date for :func:`validated`) for all else, such as 2024-6-3 or a year alone."""
    return F.when(F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(text, 1, 10).try_cast("date"))


def parse_values(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(bars, dead letters) of provider bodies ``{"values": [{"datetime", "open", ...}]}`` with numbers as strings.

    A body that is not JSON, reports an error (a status, or a code that is not 0 or empty) or has no usable row becomes a dead letter with its
    reason. Rows without finite prices are dropped, a bad volume counts as 0. The feed is adjusted already, so
    its close is the adjusted close too. ``bars`` are sorted by day within each body.
    """
    schema = "status string, code string, message string, values array<struct<datetime string, open string, high string, low string, close string, volume string>>"
    rows = raw.select("symbol", "source_id", F.col(body).alias("__body"), F.from_json(body, schema).alias("b"))

    made = F.transform("b.values", lambda v: F.struct(
        iso_date(v["datetime"]).alias("bar_date"), *[number(v[c]).alias(c) for c in PRICES], number(v["close"]).alias("close_adj"), number(v["volume"]).alias("volume")
    ))
    rows = rows.withColumn("usable", F.filter(F.coalesce(made, F.array().cast("array<struct<bar_date date, open double, high double, low double, close double, close_adj double, volume double>>")), _usable))
    error = F.coalesce(
        F.when(F.col("b").isNull(), "not a JSON object"),
        F.when((F.col("b.status") == "error") | ~F.col("b.code").isin("", "0", "false"), F.coalesce("b.message", F.concat(F.lit("error code "), "b.code"), F.lit("error"))),
        F.when(F.col("b.values").isNull() | (F.size("b.values") == 0), "no values in response"),
    )
    good, letters = _checked(rows, error)
    bars = good.select("symbol", "source_id", F.inline(F.array_sort("usable")))
    return bars.withColumn("volume", F.when(_finite("volume"), F.col("volume")).otherwise(0.0)), letters


def _usable(v: Column) -> Column:
    out = F.lit(True)
    for c in PRICES:
        out = out & F.coalesce(~F.isnan(v[c]) & (F.abs(v[c]) < float("inf")), F.lit(False))
    return out


def parse_array(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(bars, dead letters) of provider bodies ``[{"date", "open", ..., "splitFactor"}]`` with unadjusted numbers, as numbers or as strings.

    Prices are divided and volumes multiplied by all later split factors, then rounded to six places and to whole shares.
    A volume that is missing counts as 0, one that is no number stays so, for :func:`validated` to reject. A body that is no array, is empty
    or has no usable row becomes a dead letter.
    """
    said = "array<struct<date string, open string, high string, low string, close string, volume string, splitFactor string>>"
    rows = raw.select("symbol", "source_id", F.col(body).alias("__body"), F.from_json(body, said).alias("b"))
    schema = said.replace("string", "double").replace("date double", "date string")
    made = F.transform("b", lambda v: F.struct(v["date"].alias("date"), *[number(v[c]).alias(c) for c in (*PRICES, "volume", "splitFactor")]))
    rows = rows.withColumn("usable", F.filter(F.coalesce(made, F.array().cast(schema)), _usable))
    error = F.coalesce(
        F.when(F.col("b").isNull() | ~F.ltrim("__body").startswith("["), "expected an array of prices"), F.when(F.size("b") == 0, "no rows in response")
    )
    good, letters = _checked(rows, error)
    bars = good.select("symbol", "source_id", F.inline("usable")).withColumns({"bar_date": iso_date(F.col("date")), "close_adj": F.col("close"), "volume": F.coalesce("volume", F.lit(0.0))})
    return split_adjusted(bars, "splitFactor").drop("date", "splitFactor"), letters


def split_adjusted(bars: DataFrame, factor: str = "split_factor") -> DataFrame:
    """Prices divided and volumes multiplied by all later split factors; invalid factors count as 1."""
    valid = F.when((F.col(factor) > 0) & ~F.isnan(factor) & (F.abs(factor) < float("inf")), F.col(factor)).otherwise(1.0)
    later = Window.partitionBy(*KEY).orderBy("bar_date").rowsBetween(1, Window.unboundedFollowing)
    total = F.coalesce(F.exp(F.sum(F.ln(valid)).over(later)), F.lit(1.0))
    out = bars.withColumn("__by", total)
    prices = [c for c in FIELDS if c in bars.columns]
    return out.withColumns({c: F.round(F.col(c) / F.col("__by"), 6) for c in prices} | {"volume": F.when(F.isnan("volume"), F.col("volume")).otherwise(F.floor(F.col("volume") * F.col("__by") + 0.5).cast("double"))}).drop("__by")


def first_problem(today: Column) -> Column:
    """The first rule that a single bar breaks, or null; the order of rules is fixed. (A repeated date, which comes after
    a malformed one, depends on other bars: see :func:`validated`.)"""
    rules = []
    for c in FIELDS:
        rules.append(F.when(~F.coalesce(_finite(c), F.lit(False)), f"{c} is not finite"))
        rules.append(F.when(F.col(c) <= 0, f"{c} is not positive"))
    rules += [
        F.when(~F.coalesce(_finite("volume") & (F.col("volume") >= 0), F.lit(False)), "volume is not valid"),
        F.when(F.col("high") < F.col("low"), "high below low"),
        F.when(F.col("high") < F.greatest("open", "close"), "high below open or close"),
        F.when(F.col("low") > F.least("open", "close"), "low above open or close"),
        F.when(F.col("bar_date") > F.date_add(today, 1), "dated in the future"),
    ]
    return F.coalesce(*rules)


def _accepted(acc: Column, x: Column, problem: Column) -> list[Column]:
    """The last accepted bar behind ``x``."""
    return [F.when(problem.isNull(), x[new]).otherwise(acc[name]).alias(name) for name, new in (("day", "bar_date"), ("close", "close"))]


def _problem(acc: Column, x: Column) -> Column:
    """What is wrong with ``x`` behind the last accepted bar ``acc``."""
    gap = F.datediff(x["bar_date"], acc["day"])
    leap = (gap > 0) & (gap <= MAX_GAP_DAYS) & (F.abs(F.try_divide(x["close"], acc["close"]) - 1) > MAX_MOVE)
    return F.coalesce(F.when(x["bar_date"].isNull(), "malformed date"), F.when(x["bar_date"] == acc["day"], "duplicate date"), x["static"], F.when(leap, "implausible move"))


def _rejects(day: Column, close: Column) -> Column:
    """Place and problem of the bars of ``items`` that are rejected, behind a last accepted bar."""
    empty = F.struct(F.lit(0).alias("i"), day.cast("date").alias("day"), close.cast("double").alias("close"), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")).alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        problem = _problem(acc, x)
        bad = F.when(problem.isNull(), acc["bad"]).otherwise(F.map_concat(acc["bad"], F.create_map(acc["i"], F.coalesce(problem, F.lit("")))))
        return F.struct((acc["i"] + 1).alias("i"), *_accepted(acc, x, problem), bad.alias("bad"))

    return F.aggregate("items", empty, step, lambda acc: acc["bad"])


def _told(series: DataFrame, columns: list[str]) -> DataFrame:
    """The bars of ``items``, each with its problem in ``bad``."""
    out = series.select(*KEY, "bad", F.posexplode("items").alias("__i", "x")).select(*KEY, "x.*", F.try_element_at("bad", F.col("__i")).alias("problem"))
    return out.select(*columns, "problem")


def _item(rows: DataFrame) -> Column:
    return F.struct("bar_date", *[c for c in rows.columns if c not in [*KEY, "bar_date"]])


def validated(bars: DataFrame, today: Column) -> DataFrame:
    """``bars`` with ``problem``: null where accepted.

    Whether a bar repeats a date or moves too far depends on the last *accepted* bar, so each series is
    folded in order of date, then of its other columns. A series is one provider's daily history of one symbol, which
    bounds the array; the fold carries the last accepted bar and only what it rejects. :func:`validated_in_pieces` gives the same from many
    tasks a series.
    """
    rows = bars.withColumn("static", first_problem(today))
    series = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(_item(rows))).alias("items"))
    return _told(series.withColumn("bad", _rejects(F.lit(None), F.lit(None))), bars.columns)


def validated_in_pieces(bars: DataFrame, today: Column, days: int = 366) -> DataFrame:
    """:func:`validated` with each series cut into pieces of ``days`` calendar days, each folded by a task of its own.

    A bar looks back at most ``MAX_GAP_DAYS``, so a piece depends on what lies before it only through the last accepted bar, if that is one
    of the sound bars of those last days. A piece is therefore a function with a table of few rows, from each such bar, and from none,
    to the last accepted bar at the piece's own end. The tables of a series are composed in order, which tells the bar that each piece starts
    behind, and the pieces are then judged apart. Only tables meet in one task, never a series; bars without a date are judged alone.
    """
    if days < MAX_GAP_DAYS:
        raise ValueError(f"a piece takes at least {MAX_GAP_DAYS} days")
    rows = bars.withColumn("static", first_problem(today))
    place = F.datediff("bar_date", F.lit("1970-01-01").cast("date"))
    piece = F.floor(place / days)
    near = F.col("static").isNull() & ((piece + 1) * days - place <= MAX_GAP_DAYS)
    spots = F.filter(F.array(F.struct(piece.alias("piece"), F.lit(True).alias("own")), F.when(near, F.struct((piece + 1).alias("piece"), F.lit(False).alias("own")))), lambda x: x.isNotNull())
    dated = rows.where("bar_date is not null").select(*KEY, _item(rows).alias("item"), F.inline(spots))
    bar = F.struct(F.col("item.bar_date").alias("day"), F.col("item.close").alias("close"))
    pieces = dated.groupBy(*KEY, "piece").agg(
        F.array_sort(F.collect_list(F.when(F.col("own"), F.col("item")))).alias("items"), F.collect_set(F.when(~F.col("own"), bar)).alias("edges")
    ).where(F.size("items") > 0)

    none = F.struct(F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("close"))
    end = F.date_add(F.lit("1970-01-01").cast("date"), ((F.col("piece") + 1) * days - MAX_GAP_DAYS).cast("int"))

    def row(start: Column) -> Column:
        last = F.aggregate("items", F.struct(start["day"].alias("day"), start["close"].alias("close")), lambda acc, x: F.struct(*_accepted(acc, x, _problem(acc, x))))
        return F.struct(start.alias("start"), F.transform(F.array(last), lambda y: F.when(y["day"] >= end, y).otherwise(none))[0].alias("last"))

    tables = pieces.select(*KEY, F.struct("piece", F.transform(F.concat(F.array(none), "edges"), row).alias("rows")).alias("t"))
    series = tables.groupBy(*KEY).agg(F.array_sort(F.collect_list("t")).alias("tables"))
    started = F.struct(F.lit(None).cast("bigint").alias("piece"), none.alias("start"), none.alias("last"))

    def compose(done: Column, t: Column) -> Column:
        before = done[F.size(done) - 1]
        start = F.when(before["piece"] + 1 == t["piece"], before["last"]).otherwise(none)
        last = F.filter(t["rows"], lambda r: r["start"].eqNullSafe(start))[0]["last"]
        return F.concat(done, F.array(F.struct(t["piece"].alias("piece"), start.alias("start"), last.alias("last"))))

    starts = series.select(*KEY, F.inline(F.aggregate("tables", F.array(started), compose))).where("piece is not null").select(*KEY, "piece", "start")
    judged = pieces.drop("edges").join(starts, [*KEY, "piece"]).withColumn("bad", _rejects(F.col("start.day"), F.col("start.close")))
    undated = rows.where("bar_date is null").withColumn("problem", F.lit("malformed date"))
    return _told(judged, bars.columns).unionByName(undated.select(*bars.columns, "problem"))


def dead_letters(judged: DataFrame) -> DataFrame:
    """(source_id, symbol, payload, reason) of rejected bars, the bar itself as JSON."""
    fields = [c for c in judged.columns if c not in ("problem", "trust_rank", *KEY)]
    return judged.where("problem is not null").select("source_id", "symbol", F.to_json(F.struct(*fields)).alias("payload"), F.col("problem").alias("reason"))


def relative_delta(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(a - b), F.nullif(F.greatest(F.abs(a), F.abs(b)), F.lit(0.0))), F.lit(0.0))


def conflicts(bars: DataFrame) -> DataFrame:
    """One row for each field in which a lower-ranked source disagrees with the primary of that day.

    The primary is the lowest trust rank of a day; it comes from a window over (symbol, day), so no series
    is joined with itself.
    """
    day = Window.partitionBy("symbol", "bar_date").orderBy("trust_rank", "source_id")
    first = {f"p_{c}": F.first(c).over(day) for c in [*PRICES, "volume"]}
    rows = bars.withColumns({"nth": F.row_number().over(day), "p_source": F.first("source_id").over(day), **first}).where("nth > 1")
    fields = [
        F.struct(F.lit(c).alias("field"), F.col(f"p_{c}").alias("primary_value"), F.col(c).cast("double").alias("other_value"), relative_delta(F.col(f"p_{c}"), F.col(c)).alias("delta"),
                 F.lit(VOLUME_TOLERANCE if c == "volume" else PRICE_TOLERANCE).alias("tolerance"))
        for c in [*PRICES, "volume"]
    ]
    # the primary's value is what is stored
    return rows.select("symbol", "bar_date", F.col("p_source").alias("primary_source"), F.col("source_id").alias("other_source"), F.inline(F.array(*fields))).where("delta > tolerance").withColumn("resolved_to", F.col("primary_source"))


def reconciled(bars: DataFrame) -> DataFrame:
    """One bar for each symbol and day: the most trusted source, with confidence and confirmation."""
    day = Window.partitionBy("symbol", "bar_date")
    ordered = day.orderBy("trust_rank", "source_id")
    first = {f"p_{c}": F.first(c).over(ordered) for c in PRICES}
    rows = bars.withColumns({"nth": F.row_number().over(ordered), **first})
    worst = F.greatest(*[F.when(relative_delta(F.col(f"p_{c}"), F.col(c)) > PRICE_TOLERANCE, relative_delta(F.col(f"p_{c}"), F.col(c))) for c in PRICES])
    rows = rows.withColumns({
        "worst": F.max(worst).over(day), "n_sources": F.count("*").over(day), "sources": F.array_sort(F.collect_set("source_id").over(day)),
    }).where("nth = 1")
    graded = 1 - (F.col("worst") - PRICE_TOLERANCE) / (WORST_CONFLICT - PRICE_TOLERANCE) / 2
    confidence = F.when(F.col("n_sources") == 1, 0.9).when(F.col("worst").isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.round(graded, 3))))
    return rows.select("symbol", "bar_date", "source_id", *[c for c in FIELDS if c in bars.columns], "volume", confidence.alias("confidence"), F.col("worst").isNull().alias("confirmed"), "n_sources", "sources")


def gaps_filled(bars: DataFrame, primary_rank: int = 1) -> DataFrame:
    """Days that the primary source lacks and another source fills."""
    return bars.groupBy("symbol", "bar_date").agg(F.min("trust_rank").alias("best")).where(F.col("best") > primary_rank).select("symbol", "bar_date")


def insert_if_absent(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not stored yet, one for each key."""
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key by ``version``; on a tie the new one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.col(version).desc(), F.col("__new").desc())
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")


def runs(asked: DataFrame, judged: DataFrame, failures: DataFrame, n_sources: int = 2) -> DataFrame:
    """(symbol, status, rows_in, rows_rejected, note): how the ingestion of each asked symbol ended.

    ``ok`` if every source gave usable bars, ``partial`` if some did, ``failed`` if none did; always one of them, also
    where every source failed. ``failures`` holds (source_id, symbol, reason) of bodies that could not be read.
    """
    good = judged.where("problem is null").groupBy("symbol").agg(F.countDistinct("source_id").alias("given"), F.countDistinct("bar_date").alias("rows_in"))
    bad = judged.where("problem is not null").groupBy("symbol").agg(F.count("*").alias("rows_rejected"))
    why = failures.groupBy("symbol").agg(F.concat_ws("; ", F.array_sort(F.collect_set(F.concat_ws(": ", "source_id", "reason")))).alias("note"))
    out = asked.select("symbol").distinct().join(good, "symbol", "left").join(bad, "symbol", "left").join(why, "symbol", "left")
    given = F.coalesce("given", F.lit(0))
    status = F.when(given >= n_sources, "ok").when(given > 0, "partial").otherwise("failed")
    return out.select("symbol", status.alias("status"), F.coalesce("rows_in", F.lit(0)).alias("rows_in"), F.coalesce("rows_rejected", F.lit(0)).alias("rows_rejected"), "note")


def begun(asked: DataFrame) -> DataFrame:
    """Runs as they begin: ``running`` until :func:`ended`."""
    return asked.withColumn("status", F.lit("running"))


def ended(begun_runs: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Runs with the status of ``results`` (key, status); one without a result is still running, or was lost."""
    done = results.select(*key, F.col("status").alias("__s"))
    return begun_runs.join(done, key, "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")


def last_runs(rows: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` runs that began last, with their place."""
    newest = rows.orderBy(F.col("started").desc(), "symbol", "status").limit(n)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.col("started").desc(), "symbol", "status")))


def run_totals(finished: DataFrame) -> DataFrame:
    """One row: sums over runs, and how many ended each way."""
    ended = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "failed")]
    return finished.agg(F.count("*").alias("runs"), *ended, F.sum("rows_in").alias("rows_in"), F.sum("rows_rejected").alias("rows_rejected"))


def freshness(attempts: DataFrame) -> DataFrame:
    """(source_id, kind, last_success, last_attempt, consecutive_failures, last_error) from attempts
    (source_id, kind, at, error): failures since the last success count, and a success clears the error."""
    of_source = Window.partitionBy("source_id", "kind")
    rows = attempts.withColumn("good", F.max(F.when(F.col("error").isNull(), F.col("at"))).over(of_source))
    failed = F.col("error").isNotNull() & (F.col("good").isNull() | (F.col("at") > F.col("good")))
    return rows.groupBy("source_id", "kind").agg(
        F.max("good").alias("last_success"), F.max("at").alias("last_attempt"), F.count_if(failed).alias("consecutive_failures"), F.max_by("error", F.when(failed, F.struct("at", "error"))).alias("last_error")
    )


def source_health(sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every known source (source_id, kind, trust_rank) with its freshness, those never tried included."""
    return sources.join(fresh, ["source_id", "kind"], "left")


def stalest(fresh: DataFrame) -> DataFrame:
    """The one source whose last success is the oldest; sources that never succeeded come last."""
    return fresh.orderBy(F.col("last_success").asc_nulls_last(), "source_id").limit(1)


def padded(bars: DataFrame, windows: DataFrame, sessions: int = 320) -> DataFrame:
    """Bars inside any of the windows (name, low, high), each extended backward by so many sessions of the symbol.

    Each window gives one range of positions a symbol; a bar is kept once, however many ranges hold it."""
    place = Window.partitionBy("symbol").orderBy("bar_date")
    rows = bars.withColumn("__n", F.row_number().over(place))
    ranges = rows.join(windows, F.col("bar_date").between(F.col("low"), F.col("high"))).groupBy("symbol", "name").agg((F.min("__n") - sessions).alias("a"), F.max("__n").alias("b"))
    return rows.join(ranges.select("symbol", "a", "b"), (rows["symbol"] == ranges["symbol"]) & F.col("__n").between(F.col("a"), F.col("b")), "left_semi").drop("__n")
