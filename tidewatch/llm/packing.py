"""Operator 3, best-fit packing planned over a histogram of lengths.

1. Every document becomes ids plus a closing id 0, cut into pieces of at most ``capacity`` ids.
2. The pieces are counted by length: at most ``capacity`` counts, whatever the size of the corpus.
3. :func:`plan` runs best-fit decreasing over the counts. Sequences with equal contents are one
   interval of sequence numbers, so thousands of pieces are placed in a step, and the plan has
   a row for each interval and length: its size depends on the capacity only.
4. Each piece gets its rank within its length. A length that a third of all pieces share would be one
   huge window, so pieces are dealt over hash buckets: rank in (length, bucket), plus the counts of
   the buckets before it.
5. (length, rank) finds the planned slot: its sequence and the place there.

Pieces are written to the shared folder before they are counted and ranked, so that lost executors
cannot change ranks between the two. Defined results: null and empty texts are one piece holding
only id 0; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty
from tidewatch.llm.tokens import blocks, chunk_encoder, column_texts

#: Production parameters: ids in a sequence, and rows that one rank window aims at.
CAPACITY = 2048
WINDOW_ROWS = 20_000
LEAST_BUCKETS = 1024
CLOSING_ID = 0


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("__text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    closing = CLOSING_ID.to_bytes(4, "little")
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def cut(batches):
        encoder = chunk_encoder(path)
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for block in blocks(column_texts(batch, "__text")):
                rows: list[tuple] = []
                for ids, doc in zip((x + closing for x in encoder.encode(block)), keys, strict=False):
                    for piece, at in enumerate(range(0, len(ids), capacity * 4)):
                        part = ids[at : at + capacity * 4]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return source.mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts of lengths.

    Rows (length, first rank, sequences, pieces in each, first sequence, offset): pieces of a length
    from the first rank on fill these sequences in turn, each with so many from the offset on. Rows
    are sorted by length and rank. At most three intervals are made for each length, and a sequence
    holds fewer than ``sqrt(2 * capacity)`` different lengths, which bounds the rows.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> intervals of sequences
    spaces: list[int] = []  # the free spaces there are, sorted
    nxt = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if not free[space]:
                bisect.insort(spaces, space)
            free[space].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0

        def place(space: int, first: int, n: int, used: int, length: int = length) -> int:
            """Fill up to n equal sequences, each as far as the length fits; how many were touched."""
            nonlocal left, rank
            each = space // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole, each, first, used))
                rank += whole * each
                left -= whole * each
                put(space - each * length, first, whole)
            if whole < n and left:  # fewer than fill one: the last pieces of this length
                rows.append((length, rank, 1, left, first + whole, used))
                put(space - left * length, first + whole, 1)
                rank += left
                left = 0
                whole += 1
            return whole

        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                break
            space = spaces[at]
            first, n = free[space].pop()
            if not free[space]:
                spaces.pop(at)
            touched = place(space, first, n, capacity - space)
            put(space, first + touched, n - touched)
        if left:
            each = capacity // length
            n = -(-left // each)
            first, nxt = nxt, nxt + n
            place(capacity, first, n, 0)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """``pieces`` with their rank within their length, from 0, as ``rank``; no window holds a whole length."""
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n")).select(
        "length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("__in", F.row_number().over(within) - 1)
        .join(offsets, ["length", "__bucket"])
        .withColumn("rank", (F.col("__before") + F.col("__in")).cast("long"))
        .drop("__bucket", "__before", "__in")
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``."""
    pieces = stored(cut_pieces(docs, path, capacity, with_ids=with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(counts, capacity)
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // WINDOW_ROWS)
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    names = pieces.columns
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def placed(batches):
        table = shared.value
        # ranks stay below 2**50, so length and rank make one sorted key
        keys = table[:, 0] * (1 << 50) + table[:, 1]
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = column["length"].to_numpy(), column["rank"].to_numpy()
            row = table[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1]
            step = rank - row[:, 1]
            sequence = row[:, 4] + step // row[:, 3]
            offset = row[:, 5] + step % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*[column[n] for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked(pieces, buckets).mapInArrow(placed, schema + ", sequence_id long, offset long")
