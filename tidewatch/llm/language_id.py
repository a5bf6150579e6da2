"""Operator 11, language ID: multinomial naive Bayes over hashed character n-grams.

Learning: n-grams of one to three characters of the labelled texts are hashed to buckets and counted by language where the rows
lie, the counts are added up by Spark, and one matrix of log probabilities (buckets by languages) is broadcast. Its size
depends on the number of buckets and of different labels only, never on the number of rows.

Predicting: the n-grams of a batch of texts are hashed together in numpy; only the buckets that occur are looked up, and their log
probabilities are added by text. Texts longer than a slice are scored slice by slice, whole.

The model may be fitted on a bounded sample: ``SAMPLE_ROWS`` labelled rows a language, expected, drawn by a hash of the id.
Languages with fewer rows give all of them. What is known of the language of a text that is judged (its ``lang``, ``source``, id) never
enters its prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text where nothing was learned; a null id
belongs to no fold, is not held out and teaches nothing; empty and null labels: an empty label is a language named '', a null one
teaches nothing; repeated rows are judged each; ties go to the smallest label. Only the columns asked for are carried, and one
named as a column of the result comes out with ``_in`` behind it.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import carried, text_or_empty
from tidewatch.llm.tokens import blocks, column_texts

#: Production parameters: buckets of the hash, longest n-gram, smoothing, sampled rows a language, folds.
BUCKETS = 1 << 16
LONGEST = 3
SMOOTHING = 0.5
SAMPLE_ROWS = 4000
FOLDS = 5
#: Characters hashed at a time.
SLICE = 400_000
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark on one; all others count as space."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), dtype=bool, count=0x110000)


def _points(text: str) -> np.ndarray:
    """Code points of the text in lower case, runs without letters as one space, with a space at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.full(len(raw) + 2, 32, dtype=np.uint32)
    points[1:-1] = np.where(_letters()[raw], raw, 32)
    gap = points == 32
    return points[~(gap & np.concatenate([[False], gap[:-1]]))]


def grams(texts: list[str], buckets: int = BUCKETS, slice_chars: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, number of the text) of every n-gram, text by text within each pair of arrays; every n-gram comes once."""
    parts = [_points(t) for t in texts]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    points = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    for at in range(0, len(points), slice_chars):
        window, own = points[at : at + slice_chars + LONGEST - 1], owner[at : at + slice_chars + LONGEST - 1]
        rolled = np.zeros(len(window), dtype=np.uint32)
        for n in range(1, LONGEST + 1):
            count = min(slice_chars, len(window) - n + 1)
            if count <= 0:
                break
            rolled = rolled[:count] * np.uint32(0x9E3779B1) + window[n - 1 : n - 1 + count] * np.uint32(0x85EBCA6B) + np.uint32(n)
            mixed = rolled ^ (rolled >> np.uint32(15))
            mixed *= np.uint32(0x2C1B3C6D)
            mixed ^= mixed >> np.uint32(13)
            inside = own[:count] == own[n - 1 : n - 1 + count]
            yield (mixed & np.uint32(buckets - 1))[inside].astype(np.int64), own[:count][inside]


@dataclass
class Model:
    """Languages in order, log probabilities (language, bucket), and log shares of the labelled rows."""

    langs: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log joint probabilities, texts by languages."""
        out = np.tile(self.prior, (len(texts), 1))
        buckets = self.weights.shape[1]
        for bucket, own in grams(texts, buckets, max(20_000, min(SLICE, 4_000_000 // max(1, len(self.langs))))):
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            for k, row in enumerate(self.weights):
                out[own[starts], k] += np.add.reduceat(row[bucket], starts, dtype=np.float64)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        lettered = [bool(_LETTER.search(t)) for t in texts]
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        scores = self.scores(texts)
        best = scores.argmax(axis=1)
        share = 1.0 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.langs[b] if has else UNDETERMINED for b, has in zip(best, lettered, strict=True)]
        return names, np.where(lettered, share, 0.0)


def fold(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds


def _counted(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of each language's buckets over all batches of a task."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), column_texts(batch, "__text")
        for lang in set(langs):
            total = seen.setdefault(lang, np.zeros(buckets, dtype=np.int64))
            for block in blocks([t for t, own in zip(texts, langs, strict=True) if own == lang], SLICE):
                for bucket, _ in grams(block, buckets):
                    total += np.bincount(bucket, minlength=buckets)
    for lang, total in seen.items():
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Model:
    """Learn from the rows of ``labelled`` that have a label and an id; about ``sample_rows`` of each label are read in full."""
    rows = labelled.select(F.col(doc_id).alias("__id"), F.col(lang).alias("lang"), text_or_empty(text).alias("__text")).where("lang is not null and __id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, buckets)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, sample_rows / sizes[name]))])
    drawn = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "__text")
    counts = drawn.mapInArrow(lambda batches: _counted(batches, buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {name: k for k, name in enumerate(langs)}
    matrix = np.full((len(langs), buckets), SMOOTHING)
    if counts.num_rows:
        at = np.array([place[x] for x in counts["lang"].to_pylist()])
        matrix[at, counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    total = np.array([sizes[name] for name in langs], dtype=np.float64)
    return Model(langs, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32), np.log(total / total.sum()))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*carried(keep, ["lang_pred", "score"]), F.col(text).alias("__text"))
    kept = tuple(source.columns[:-1])
    schema = T.StructType([source.schema[k] for k in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judged(batches):
        for batch in batches:
            names, scores = [], []
            for block in blocks(column_texts(batch, "__text"), SLICE):
                found, share = shared.value.predict(block)
                names += found
                scores.append(share)
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(judged, schema)


def held_out_languages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the documents of all folds but 0 and judge every document; ``held_out`` marks fold 0."""
    model = fit(docs.where(fold() != 0))
    marked = docs.withColumn("__held", F.coalesce(fold() == 0, F.lit(False)))
    own = carried(keep, ["held_out", "lang_pred", "score"])
    named = marked.select(*own, "__held", F.col("text").alias("__whole"))
    out = identify(named, model, (*named.columns[:-1],), "__whole")
    return out.withColumnRenamed("__held", "held_out").select(*named.columns[:-2], "held_out", "lang_pred", "score")
