"""What readers change: cursors, read and snoozed events, and watchlists. Each change is a join and gives the whole new
table; a table that changes at every step is kept by :mod:`tidewatch.streaming.feeds`. ``now`` is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a reader may say of a name, and how much a request may hold.
INTENTS = ["CONSIDERING_BUY", "HOLDING", "THEMATIC", "HEDGE", "NONE"]
PRIORITIES = ["HIGH", "NORMAL", "LOW"]
MAX_IDS = 500
MAX_SNOOZE_HOURS = 336
MAX_SYMBOL = 10


def mark_seen(cursors: DataFrame, seen: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Cursors after readers have seen names up to a time: they only move forward, and count versions.

    With ``bars`` a cursor that moves takes along the day and close of the newest bar (snap_date, snap_close).
    """
    latest = seen.groupBy("user_id", "symbol").agg(F.max("seen_at").alias("seen_at"))
    rows = cursors.join(latest, ["user_id", "symbol"], "full")
    moved = F.coalesce(F.col("seen_at") > F.col("last_seen"), F.col("last_seen").isNull())
    out = rows.select(
        "user_id", "symbol", F.greatest("last_seen", "seen_at").alias("last_seen"), (F.coalesce("version", F.lit(0)) + moved.cast("int")).alias("version"), moved.alias("moved")
    )
    if bars is None:
        return out.drop("moved")
    newest = bars.groupBy("symbol").agg(F.max("bar_date").alias("d"), F.max_by("close_adj", "bar_date").alias("c"))
    out = out.join(newest, "symbol", "left")
    snaps = {"snap_date": F.when(F.col("moved"), F.col("d")), "snap_close": F.when(F.col("moved"), F.col("c"))}
    return out.withColumns(snaps).select("user_id", "symbol", "last_seen", "version", "snap_date", "snap_close")


def ensure_cursors(cursors: DataFrame, watch: DataFrame, now: Column) -> DataFrame:
    """Cursors planted where a watched name has none."""
    missing = watch.select("user_id", "symbol").distinct().join(cursors.select("user_id", "symbol"), ["user_id", "symbol"], "left_anti")
    return cursors.unionByName(missing.select("user_id", "symbol", now.alias("last_seen"), F.lit(0).alias("version")))


def latest(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with their key (one of them, where new repeats a key)."""
    order = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in new.columns if c not in key])
    one = new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return stored.join(one.select(*key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def seen_events(states: DataFrame, seen: DataFrame) -> DataFrame:
    """Read states (user_id, fingerprint, status, until) after events were seen."""
    return latest(states, seen.select("user_id", "fingerprint", F.lit("SEEN").alias("status"), F.lit(None).cast("date").alias("until")), ["user_id", "fingerprint"])


def snooze(states: DataFrame, asked: DataFrame, events: DataFrame, watch: DataFrame) -> DataFrame:
    """Read states after readers have snoozed events: (user_id, fingerprint, until) of ``asked``.

    Only events of names that the reader watches can be snoozed; the others are left out. Cursors do not move.
    """
    owned = asked.join(events.select("fingerprint", "symbol").distinct(), "fingerprint").join(watch.select("user_id", "symbol"), ["user_id", "symbol"], "left_semi")
    return latest(states, owned.select("user_id", "fingerprint", F.lit("SNOOZED").alias("status"), "until"), ["user_id", "fingerprint"])


def watch_add(watch: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """Watchlist (user_id, symbol, intent, priority) after names were added or changed; names that ``known`` lacks are
    left out. Cursors of added names are planted with :func:`ensure_cursors`."""
    return latest(watch, new.join(known.select("symbol"), "symbol", "left_semi"), ["user_id", "symbol"])


def watch_patch(watch: DataFrame, changes: DataFrame) -> DataFrame:
    """Watchlist with the intents and priorities of ``changes`` where these are not null; names not watched stay so."""
    new = changes.select("user_id", "symbol", F.col("intent").alias("__i"), F.col("priority").alias("__p"))
    rows = watch.join(new, ["user_id", "symbol"], "left")
    return rows.withColumns({"intent": F.coalesce("__i", "intent"), "priority": F.coalesce("__p", "priority")}).select(*watch.columns)


def watch_remove(watch: DataFrame, gone: DataFrame) -> DataFrame:
    """Watchlist without the (user_id, symbol) of ``gone``."""
    return watch.join(gone.select("user_id", "symbol"), ["user_id", "symbol"], "left_anti")


def available(known: DataFrame, watch: DataFrame, user_id: int) -> DataFrame:
    """Active instruments, no funds, that a reader does not watch yet."""
    return known.where("is_active and not is_fund").join(watch.where(F.col("user_id") == user_id).select("symbol"), "symbol", "left_anti")


def explain_event(events: DataFrame, watch: DataFrame, user_id: int, fingerprint: str) -> DataFrame:
    """The one event with its reasons, no row if the reader does not watch its name. ``events`` come with contributions."""
    from tidewatch.operators.score import explained

    ups, downs = explained(F.col("contributions"))
    mine = events.where(F.col("fingerprint") == fingerprint).join(watch.where(F.col("user_id") == user_id).select("symbol"), "symbol", "left_semi")
    return mine.select("fingerprint", "symbol", "bar_date", "detector", "headline", "score", "severity", ups.alias("positives"), downs.alias("suppressors"))


def check_request(ids: list | None = None, snooze_hours: float | None = None, symbol: str | None = None, intent: str | None = None, priority: str | None = None, first: dt.date | None = None, last: dt.date | None = None) -> None:
    """Raise ValueError if an argument of a request is out of its bounds; what is None is not checked."""
    if ids is not None and len(ids) > MAX_IDS:
        raise ValueError(f"at most {MAX_IDS} ids")
    if snooze_hours is not None and not 1 <= snooze_hours <= MAX_SNOOZE_HOURS:
        raise ValueError(f"a snooze takes 1 to {MAX_SNOOZE_HOURS} hours")
    if symbol is not None and not 1 <= len(symbol.strip()) <= MAX_SYMBOL:
        raise ValueError(f"a symbol has 1 to {MAX_SYMBOL} characters")
    if intent is not None and intent not in INTENTS:
        raise ValueError(f"unknown intent {intent}")
    if priority is not None and priority not in PRIORITIES:
        raise ValueError(f"unknown priority {priority}")
    if first is not None and last is not None and first > last:
        raise ValueError("the range ends before it starts")
