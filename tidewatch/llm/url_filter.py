"""Operator 7, URL filters by a temporal list join.

Dated entries of a list (pattern, entry_date, verdict: ``block``, ``allow`` or ``none``) become
validity intervals: an entry holds from its date to the day before the next entry of its pattern. A
pattern is a domain, which holds for all its subdomains, or a host with a path prefix ending in ``/``.
Every capture is judged by the entries active on the day of its fetch; the longest active pattern wins.

Captures are reduced to different (url, day) pairs without page bodies. Each offers its domain suffixes
and path prefixes as keys, with the month of its fetch. Intervals are split at months, so the as-of
join is an equality of (pattern, month) with the days as a residual: a pattern with a long history is not
compared entry by entry. Both sides of the joins are shuffled or broadcast by size, as Spark sees it,
and hot hosts are split by skew handling.

Defined results: a null url has no host and is not blocked; a null date meets no entry; two entries of a
pattern on one day count as the greater verdict in the order block, allow, none; repeated captures are
judged each; extra columns of both tables are carried or ignored. An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import carried, stored

# How the verdicts of one pattern and day are ordered.
ORDER = {"none": 0, "allow": 1, "block": 2}


def url_host(url: Column) -> Column:
    """The lower-case host, without user, port and closing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, valid_from, valid_to): valid_to is the last day, null while the entry still holds."""
    rank = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    known = entries.where(F.col("pattern").isNotNull() & F.col("entry_date").isNotNull() & F.col("verdict").isin(list(ORDER)))
    daily = known.groupBy("pattern", "entry_date").agg(F.max_by("verdict", rank[F.col("verdict")]).alias("verdict"))
    after = Window.partitionBy("pattern").orderBy("entry_date")
    held = daily.select("pattern", "verdict", F.col("entry_date").alias("valid_from"), F.date_sub(F.lead("entry_date").over(after), 1).alias("valid_to"))
    return held.where("verdict <> 'none'")


def _keys(host: Column, path: Column) -> Column:
    """Patterns that can hold for a URL: domain suffixes down to the last label, and path prefixes."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parts = F.split(path, "/")
    prefixes = F.when(
        F.size(parts) > 2,
        F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(suffixes, prefixes))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """All rows and columns of ``captures`` with host, blocked, and the pattern, verdict and start that decided. A column of
    captures that is named as one of these comes out with ``_in`` behind it."""
    pairs = captures.select(F.col(url).alias("__url"), F.col(day).alias("__day")).where("__url is not null and __day is not null").distinct()
    span = pairs.agg(F.min("__day").alias("low"), F.max("__day").alias("high")).first()
    held = intervals(entries)
    low, high = F.lit(span["low"]).cast("date"), F.lit(span["high"]).cast("date")
    first, last = F.greatest("valid_from", low), F.least(F.coalesce("valid_to", high), high)
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    # ending in a write, so that both sides of the join below come from exchanges that Spark can split
    held = stored(held.where(first <= last).withColumn("__month", F.explode(months)), "intervals")
    keyed = pairs.withColumn("__host", url_host(F.col("__url"))).where("__host is not null")
    keyed = keyed.select("__url", "__day", F.explode(_keys(F.col("__host"), url_path(F.col("__url")))).alias("pattern")).withColumn("__month", F.trunc("__day", "month"))
    active = keyed.join(held, ["pattern", "__month"]).where((F.col("__day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__day") <= F.col("valid_to"))))
    best = active.groupBy("__url", "__day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "verdict", "valid_from")).alias("__best"))
    best = stored(best, "verdicts")
    mine = captures.withColumn("__u", F.col(url)).withColumn("__d", F.col(day))
    joined = mine.join(best, (F.col("__u") == F.col("__url")) & (F.col("__d") == F.col("__day")), "left")
    out = [
        url_host(F.col("__u")).alias("host"),
        (F.coalesce(F.col("__best.verdict"), F.lit("none")) == "block").alias("blocked"),
        F.col("__best.pattern").alias("list_pattern"),
        F.col("__best.verdict").alias("list_verdict"),
        F.col("__best.valid_from").alias("list_since"),
    ]
    return joined.select(*carried(tuple(captures.columns), ["host", "blocked", "list_pattern", "list_verdict", "list_since"]), *out)
