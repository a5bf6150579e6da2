"""What an application asks for, as functions: one reader's brief, the reasons of an event, health, and a report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import storage
from tidewatch.operators import brief as brief_ops
from tidewatch.operators import score, state
from tidewatch.plans import briefs, queries, registry
from tidewatch.plans.ingestion import fresh_sources
from tidewatch.plans.queries import QUERIES


def brief(spark: SparkSession, sf_dir: str, user_id: int, now: str = briefs.NOW) -> dict[str, DataFrame]:
    """A reader's ``brief`` at the day ``now`` (one row: counts, story, items with their windows and reasons' headline, themes with their names), and the
    ``items`` with all reasons, in order, ``summary``, ``themes``, ``histogram`` and ``quality``. Only this reader's names are computed. A reader who watches nothing gets the one row without items."""
    at, mine = F.lit(now).cast("date"), F.col("user_id") == user_id
    watch = briefs.readers(spark, sf_dir).where(mine)
    events = registry.events(spark, sf_dir).where(F.col("bar_date") <= at).join(watch.select("symbol").distinct(), "symbol", "left_semi")
    states = briefs.dealt_states(events, watch)
    shown = storage.stored(brief_ops.visible(events, watch, states, at), "visible")
    asleep = brief_ops.snoozed_names(brief_ops.past_cursor(events, watch), shown, states, at)
    users = spark.createDataFrame([(user_id,)], "user_id long")
    found = brief_ops.items(shown, explain=True)
    bars = registry.bars(spark, sf_dir).where(F.col("bar_date") <= at)
    stats = brief_ops.window_stats(bars.where("kind = 'instrument'"), watch)
    whole = storage.stored(briefs.whole_briefs(spark, sf_dir, users, watch, at, shown, asleep), "brief")
    return {
        "brief": whole, "items": brief_ops.ranked(found, briefs.BUDGET).where("shown").orderBy("place"), "histogram": brief_ops.histogram(watch, found, asleep),
        "summary": whole.drop("items", "themes"), "themes": whole.select("user_id", F.inline("themes")),
        "quality": brief_ops.quality(watch, found, briefs.BUDGET, stats, bars, fresh_sources(spark, sf_dir), at),
    }


def explain_event(spark: SparkSession, sf_dir: str, user_id: int, fingerprint: str) -> DataFrame:
    """One event with its reasons; no row if the reader does not watch its name."""
    events = score.score_events(registry.candidates(spark, sf_dir), explain=True)
    return state.explain_event(events, briefs.readers(spark, sf_dir), user_id, fingerprint)


def pipeline_health(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: QUERIES[n](spark, sf_dir) for n in ("ops_counts", "ops_sources", "ops_stalest", "ingest_run_totals", "ops_last_runs", "severity_histogram")}


def replay(spark: SparkSession, sf_dir: str, first: str, last: str, symbols: list[str] | None = None) -> DataFrame:
    """Every session of the range in order: items with reasons, themes, story, the market's return, and how many names were quiet."""
    state.check_request(first=dt.date.fromisoformat(first), last=dt.date.fromisoformat(last))
    names = None if symbols is None else spark.createDataFrame([(s,) for s in symbols], "symbol string")
    return briefs.replayed(spark, sf_dir, first, last, names).orderBy("bar_date")


def calibration_report(spark: SparkSession, sf_dir: str) -> str:
    """The calibration as Markdown."""
    parts = {"Summary": queries.calibration_summary, "Detectors": queries.calibration_detectors, "Follow-through": queries.calibration_follow_through, "Severity": queries.severity_histogram, "Rates": queries.calibration_rate}
    return storage.report("Calibration", {n: q(spark, sf_dir) for n, q in parts.items()})
