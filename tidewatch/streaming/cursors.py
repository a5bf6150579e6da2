"""Cursors and snoozes as keyed state: one state a reader and name, fed by acknowledgements that may come late, twice and in any order.

An acknowledgement moves a cursor forward only, counts a version and takes along the close that the reader saw; a snooze is replaced
by one that was asked for later, and ends when a brief's ``now`` has passed it; :func:`woken` tells it by timers when that happens. Cursor and snooze therefore do not depend on the order in which
acknowledgements come (the version does: it counts how often the cursor moved, and never goes back). State lies in RocksDB beside the query's
checkpoint, two small values a key, so a reader with very many names is many keys, not one large state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# times are microseconds, which no time zone of a worker can shift
CURSOR = "last_seen long, version long, snap_close double"
SNOOZE = "at long, until long"
RESULT = "user_id long, symbol string, last_seen long, version long, snap_close double, until long"


class Reader(StatefulProcessor):
    """The state of one reader and name; gives it as a row when an acknowledgement has changed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", CURSOR)
        self.snooze = handle.getValueState("snooze", SNOOZE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        cursor = tuple(self.cursor.get()) if self.cursor.exists() else None
        snooze = tuple(self.snooze.get()) if self.snooze.exists() else None
        before = cursor, snooze
        for row in rows:
            if row["at"] is None:
                continue
            if row["kind"] == "seen" and (cursor is None or row["at"] > cursor[0]):
                cursor = row["at"], (cursor[1] if cursor else 0) + 1, row["snap_close"]
            elif row["kind"] == "snooze" and row["until"] is not None and (snooze is None or (row["at"], row["until"]) > snooze):
                snooze = row["at"], row["until"]
        if (cursor, snooze) == before:
            return
        if cursor != before[0]:
            self.cursor.update(cursor)
        if snooze != before[1]:
            self.snooze.update(snooze)
        last_seen, version, close = cursor or (None, 0, None)
        yield Row(user_id=key[0], symbol=key[1], last_seen=last_seen, version=version, snap_close=close, until=snooze[1] if snooze else None)

    def close(self) -> None:
        pass


def reader_states(acknowledged: DataFrame) -> DataFrame:
    """Changes of cursors and snoozes from a stream (user_id, symbol, kind, at, until, snap_close), kind ``seen`` or ``snooze``, in update mode.

    The last row of a reader and name, by version and then by ``until``, is its state; it is asleep while ``until`` is ahead of the reader's clock.
    Sets the session's state store to RocksDB, which keyed state needs.
    """
    acknowledged.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    told = acknowledged.select("user_id", "symbol", "kind", F.unix_micros("at").alias("at"), F.unix_micros("until").alias("until"), "snap_close")
    out = told.groupBy("user_id", "symbol").transformWithState(Reader(), RESULT, "Update", "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("last_seen", "until")})


BUCKETS = 1024


def _frame(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas()


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _awake(rows: pd.DataFrame, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame, int]:
    """(snoozes that have ended, those to keep, when the next one ends) of all snoozes of some names at ``watermark``; times of timers are milliseconds.

    When the watermark is past an end, every snooze asked for before it has come, so whether another one has replaced it is known for good. Kept are
    snoozes that have not ended, and replaced ones as long as one that they replace may come.
    """
    key = ["user_id", "known", "symbol"]
    # of two asked for at once the longer one
    rows = rows.sort_values([*key, "at", "lasts"]).drop_duplicates([*key, "at"], keep="last")
    code = rows.groupby(key, dropna=False, sort=False).ngroup().to_numpy()
    at = rows["at"].to_numpy()
    until = at + rows["lasts"].to_numpy()
    replaced = np.zeros(len(rows), bool)
    replaced[:-1] = (code[1:] == code[:-1]) & (at[1:] <= until[:-1])
    ends = -(-until // 1000)
    ended = ~replaced & (ends < watermark)
    keep = ~ended & ~(replaced & (at <= watermark * 1000))
    due = ends[keep & ~replaced]
    return rows[ended], rows[keep], int(due.min()) if len(due) else 0


def _wake(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add the snoozes of a bucket to those it holds; give those that have ended, and set the bucket's timer to the next end."""
    columns = ["user_id", "known", "symbol", "at", "lasts"]
    held = _frame(state.get[0]) if state.exists else None
    fresh = [] if state.hasTimedOut else [f.loc[f["lasts"] > 0, columns] for f in frames]
    parts = [f for f in (held, *fresh) if f is not None and len(f)]
    rows = pd.concat(parts, ignore_index=True) if parts else None
    if rows is None:
        return
    ended, kept, due = _awake(rows, state.getCurrentWatermarkMs())
    if len(kept):
        state.update((_packed(kept),))
        state.setTimeoutTimestamp(max(due, 1))
    elif state.exists:
        state.remove()
    if len(ended):
        yield ended.assign(user_id=ended["user_id"].astype("Int64").where(ended["known"]), until=ended["at"] + ended["lasts"])[["user_id", "symbol", "at", "until"]]


def woken(snoozes: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, symbol, at, until) of snoozes that have ended without being replaced, from a stream (user_id, symbol, at, until), in append mode.

    A snooze is replaced by one of the same reader and name that is asked for later, up to its end; of two asked for at once the longer one
    counts. It wakes when the watermark (the latest ``at``, less ``delay``) is past its end. A row that comes later than ``delay`` is dropped, as
    streams in event time do; a row without a time, and one that ends before it begins, is none. Sets the session's state store to RocksDB.

    Readers and names are dealt into ``buckets``; one holds its snoozes as a compressed table and is worked on at once, since a call into Python for each
    name or snooze costs many times the work. A batch rewrites the buckets that it meets; more of them make each smaller.
    """
    snoozes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    told = snoozes.select("user_id", "symbol", F.col("at").alias("clock"), F.unix_micros("at").alias("at"), F.unix_micros("until").alias("until")).withWatermark("clock", delay)
    zero = F.lit(0).cast("long")
    # integers that may be null would become floating point in pandas; a length takes less room than an end
    rows = told.select(
        F.pmod(F.xxhash64("user_id", "symbol"), F.lit(buckets)).alias("bucket"), F.coalesce("user_id", zero).alias("user_id"), F.col("user_id").isNotNull().alias("known"), "symbol", "clock",
        F.coalesce("at", zero).alias("at"), F.coalesce(F.col("until") - F.col("at"), zero).alias("lasts"),
    )
    out = rows.groupBy("bucket").applyInPandasWithState(_wake, "user_id long, symbol string, at long, until long", "packed binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "until")})
