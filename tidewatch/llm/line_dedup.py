r"""Operator 1, line dedup over levelled sorted runs of line hashes (native).

A text is split at ``\n``. A line's key is the line without white space at both ends and with A-Z in
lower case; keys shorter than ``MIN_CHARS`` never take part. :class:`LineRuns` keeps what is known of
the keys as *runs*: tables of (two 64-bit hashes, documents, last document), bucketed and sorted by
the hashes, in the shared folder. Each new batch of documents

1. is reduced to its own sorted run, one row for each key;
2. merge-anti-joins the runs there are, which tells its new keys from known ones;
3. becomes a pair of runs of level 0: its new keys, and what it adds to known ones.

When a level has ``fanout`` pairs they are merged into one of the next level. All runs have the
same buckets and order, so joins of runs go without a shuffle and without a sort. Two 64-bit
hashes with different seeds make a key of 128 bits, so that clashes stay unlikely at any size.

The retrospective rule of :func:`dedup_lines`: a key found in at least ``min_docs`` documents loses
all its lines except in the largest ``doc_id`` that holds it.

Defined results: null and empty texts are one empty line. Each row counts as one document, so repeated
rows count each; rows sharing a ``doc_id`` keep or lose a key together. A null ``doc_id`` counts
and is never the largest. Extra columns are carried if asked for; one named as a column of the
result comes out with ``_in`` behind it. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE, carried, remove, stored, text_or_empty, work_dir

#: Production parameters.
MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
SEED = "tidewatch"
HASHES = ["h1", "h2"]


def _ascii_lower(line: Column) -> Column:
    """A-Z lowered only: the quick function where all is ASCII, a character table elsewhere."""
    table = F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(table)


def line_key(line: Column) -> Column:
    return _ascii_lower(F.btrim(line, F.lit(SPACE)))


def _is_long(line: Column, min_chars: int) -> Column:
    return (F.length(line) >= min_chars) & (F.length(F.btrim(line, F.lit(SPACE))) >= min_chars)


def document_keys(docs: DataFrame, min_chars: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h1, h2): each different long key of each row once."""
    lines = F.filter(F.split(text_or_empty(text), "\n"), lambda x: _is_long(x, min_chars))
    keys = F.array_distinct(F.transform(lines, line_key))
    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.explode_outer(keys).alias("__key"))
    # the outer form and this test in place of a plain explode, whose inferred filter would build the keys twice
    return out.where("__key is not null").select("doc_id", F.xxhash64("__key").alias("h1"), F.xxhash64(F.lit(SEED), "__key").alias("h2"))


ORDERING = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """Levelled sorted runs in the shared folder; ``buckets`` bounds the keys of one merge task.

    A level holds pairs of a run of new keys and a run of additions to keys of earlier pairs. Runs of new
    keys never share a key, thanks to the anti join, so merging them needs no aggregation.

    A run has one sorted file for each bucket, and scans tell Spark their order (a setting that is put back by
    :meth:`close`), so that joins of runs merge them as they are, without a sort. What the runs are is kept in the folder
    after each batch: a later job goes on with :meth:`reopen`, and a run that a lost driver left unfinished is not part of it.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT, folder: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or work_dir(spark, "runs")
        self.levels: list[list[tuple[str, str]]] = []
        self.tables: set[str] = set()
        self.replaced: list[str] = []
        self.saves = 0
        self.before = spark.conf.get(ORDERING, None)
        spark.conf.set(ORDERING, "true")

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str) -> "LineRuns":
        """The runs that an earlier job left in ``folder``, as of its last whole batch."""
        saved = spark.read.json(f"{folder}/levels-*").orderBy(F.col("save").desc()).first()
        runs = cls(spark, saved["buckets"], saved["fanout"], folder)
        runs.saves = saved["save"]
        runs.levels = [[(p[0], p[1]) for p in level] for level in json.loads(saved["levels"])]
        for name in (n for pair in runs.pairs for n in pair):
            runs._declare(name)
        return runs

    def _declare(self, name: str) -> None:
        self.spark.sql(
            f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n_docs BIGINT, last_doc BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
        )
        self.tables.add(name)

    def _save(self) -> None:
        """What belongs to the runs, written after each batch; the newest one counts."""
        self.saves += 1
        row = [(self.saves, self.buckets, self.fanout, json.dumps(self.levels))]
        self.spark.createDataFrame(row, "save long, buckets int, fanout int, levels string").coalesce(1).write.json(f"{self.folder}/levels-{self.saves}")
        self._drop(*self.replaced)  # only now: what was saved before still names them
        self.replaced = []

    def _write(self, rows: DataFrame, dealt: bool = False) -> str:
        """A new run, one sorted file for each bucket; ``dealt`` rows come from joins of runs, a task for each bucket."""
        name = f"run_{uuid.uuid4().hex}"
        rows = rows.select(*HASHES, "n_docs", "last_doc")
        rows = rows if dealt else rows.repartition(self.buckets, *HASHES)
        rows.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.tables.add(name)
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.tables.discard(name)
            remove(self.spark, f"{self.folder}/{name}")

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return [pair for level in self.levels for pair in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (with h1, h2) whose key no run holds: one merge anti join for each run of new keys."""
        for new, _ in self.pairs:
            batch = batch.join(self._read(new).select(*HASHES).hint("merge"), HASHES, "left_anti")
        return batch

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2) rows, one for each row of documents and key."""
        own = self._write(keys.groupBy(*HASHES).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        rows = self._read(own)
        if not self.pairs:
            self._place((own, self._write(rows.limit(0))), 0)
            self._save()
            return
        new = self._write(self.unseen(rows), dealt=True)
        known = self._write(rows.join(self._read(new).select(*HASHES).hint("merge"), HASHES, "left_anti"), dealt=True)
        self._drop(own)
        self._place((new, known), 0)
        self._save()

    def _place(self, pair: tuple[str, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(pair)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._merge([n for n, _ in old]), self._merge([k for _, k in old])
            self.replaced += [n for names in old for n in names]
            self._place(merged, level + 1)

    def _merge(self, names: list[str]) -> str:
        """One run out of several, two by two: a full merge join of runs that are dealt and sorted alike."""
        while len(names) > 1:
            a, b = self._read(names[0]), self._read(names[1]).select(*HASHES, F.col("n_docs").alias("__n"), F.col("last_doc").alias("__last"))
            both = a.hint("merge").join(b.hint("merge"), HASHES, "full")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("__n", F.lit(0))
            made = self._write(both.select(*HASHES, total.alias("n_docs"), F.greatest("last_doc", "__last").alias("last_doc")), dealt=True)
            names = [*names[2:], made]
        return names[0]

    def _union(self, names: list[str]) -> DataFrame:
        rows = self._read(names[0])
        for name in names[1:]:
            rows = rows.unionByName(self._read(name))
        return rows

    def _summed(self, names: list[str]) -> DataFrame:
        return self._union(names).groupBy(*HASHES).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def keys(self) -> DataFrame:
        """What all runs together know: one row for each key."""
        new = self._union([n for n, _ in self.pairs])
        more = self._summed([k for _, k in self.pairs]).select(*HASHES, F.col("n_docs").alias("__n"), F.col("last_doc").alias("__last"))
        return new.join(more.hint("merge"), HASHES, "left").select(
            *HASHES,
            (F.col("n_docs") + F.coalesce("__n", F.lit(0))).alias("n_docs"),
            F.greatest("last_doc", "__last").alias("last_doc"),
        )

    def release(self) -> None:
        """Forget the tables and put the setting back; the runs stay in the folder for :meth:`reopen`."""
        for name in sorted(self.tables):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()
        if self.before is None:
            self.spark.conf.unset(ORDERING)
        else:
            self.spark.conf.set(ORDERING, self.before)

    def close(self) -> None:
        """Release the runs and delete them."""
        self.release()
        self.levels = []
        remove(self.spark, self.folder)


def _in_batches(keys: DataFrame, batches: int) -> list[DataFrame]:
    """``keys`` in the order of doc_id, in about equal parts; together they are all rows."""
    cuts = keys.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    doc = F.col("doc_id")
    parts, low = [], None
    for cut in cuts:
        parts.append(keys.where(doc.isNull() | (doc <= cut) if low is None else (doc > low) & (doc <= cut)))
        low = cut
    parts.append(keys.where(doc > low) if low is not None else keys)
    return parts


def repeated_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h1, h2, last_doc) of every key found in ``min_docs`` documents or more, through the runs."""
    spark = docs.sparkSession
    keys = stored(document_keys(docs, min_chars, key, text), "line-keys")
    runs = LineRuns(spark, fanout=fanout)
    try:
        for batch in _in_batches(keys, batches):
            runs.add(batch)
        return stored(runs.keys().where(F.col("n_docs") >= min_docs).select(*HASHES, "last_doc"), "repeated-lines")
    finally:
        runs.close()


def dedup_lines(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns ``keep`` of each row with n_lines, n_dropped and the text that stays, as ``kept_text``.

    Only places of dropped lines travel: the lines of the corpus meet the repeated keys as hashes with
    their position, and each row then meets its own positions.
    """
    repeated = repeated_keys(docs, min_docs, min_chars, batches, fanout, key, text)
    rows = docs.select(
        F.struct(*carried(keep, ["n_lines", "n_dropped", "kept_text"])).alias("__kept"), F.col(key).cast("long").alias("__doc"), text_or_empty(text).alias("__text")
    ).withColumn("__row", F.xxhash64("__text"))
    lines = rows.select("__doc", "__row", F.posexplode_outer(F.split("__text", "\n")).alias("__at", "__line")).where(_is_long(F.col("__line"), min_chars))
    lines = lines.withColumn("__key", line_key(F.col("__line"))).select(
        "__doc", "__row", "__at", F.xxhash64("__key").alias("h1"), F.xxhash64(F.lit(SEED), "__key").alias("h2")
    )
    dropped = (
        lines.join(repeated, HASHES)
        .where(~F.col("__doc").eqNullSafe(F.col("last_doc")))
        .groupBy(F.col("__doc").alias("__d"), F.col("__row").alias("__r"))
        .agg(F.collect_set("__at").alias("__drop"))  # a set: repeated rows give each place once
    )
    joined = rows.join(dropped, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")), "left").withColumn("__lines", F.split("__text", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    return (
        joined.withColumn("__places", F.when(F.col("__drop").isNotNull(), places))
        .select(
            "__kept.*",
            F.size("__lines").cast("long").alias("n_lines"),
            F.when(F.col("__places").isNull(), F.lit(0)).otherwise(F.size("__lines") - F.size("__places")).cast("long").alias("n_dropped"),
            F.when(F.col("__places").isNull(), F.col("__text")).otherwise(F.array_join(F.transform("__places", lambda i: F.get(F.col("__lines"), i)), "\n")).alias("kept_text"),
        )
    )
