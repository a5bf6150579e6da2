"""Operator 2, token counts: overlap resynchronisation for huge documents.

Texts of one chunk are counted through the word cache of :mod:`tidewatch.llm.tokens`. Every text longer
than one chunk is cut into overlapping chunks that the library encodes with offsets, each
without seeing the others, a few at a time so that memory stays bounded. Neighbours are spliced at
a proven common boundary:

* the left chunk starts at a proven boundary, and splitting reads from left to right, so all its
  split boundaries are those of the whole text, except near its cut end (``GUARD`` characters, more
  than the longest added token or contraction);
* splitting has no look-behind, so once the right chunk has a split boundary at such a place, all
  that it finds from there on is what the whole text gives.

Places beside combining marks, or characters that lower-casing lengthens, are not taken, since
their offsets are ambiguous. If an overlap has no common boundary, the left chunk is encoded again from its proven start with an
overlap twice as wide, and so on until a boundary is shared or the right chunk is swallowed whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
only the columns asked for are carried, and one named as a column
of the result comes out with ``_in`` behind it.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import carried, text_or_empty
from tidewatch.llm.tokens import blocks, chunk_encoder, column_texts, tokenizer

#: Production parameters: a text of more than one chunk is cut into chunks of this size.
CHUNK_CHARS = 16_384
OVERLAP = 256
GUARD = 32
CHUNKS_AT_A_TIME = 8


def _encoded(tok, text: str, spans: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """For each span, where its splits start in the text, and the number of tokens before each."""
    out = []
    for (start, _), enc in zip(spans, tok.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False), strict=True):
        starts, before, last = [], [], object()
        for i, (word, (at, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
            if word is None or word != last:
                starts.append(start + at)
                before.append(i)
            last = word
        before.append(len(enc.ids))
        out.append((starts, before))
    return out


def _plain(text: str, at: int) -> bool:
    """Whether no character beside this place can combine with another or change its length."""
    return all(unicodedata.category(c)[0] != "M" and len(c.lower()) == 1 for c in text[max(0, at - 1) : at + 1])


def count_huge(path: str, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, as the library counts them on the whole."""
    tok, n = tokenizer(path), len(text)
    total = proven = 0
    left: tuple[list[int], list[int]] | None = None
    end = 0
    cuts = list(range(0, max(n, 1), chunk))
    for at in range(0, len(cuts), CHUNKS_AT_A_TIME):
        spans = [(max(0, c - overlap), min(n, c + chunk)) for c in cuts[at : at + CHUNKS_AT_A_TIME]]
        for span, right in zip(spans, _encoded(tok, text, spans), strict=True):
            if left is None:
                left, end = right, span[1]
                continue
            if span[1] <= end:  # already swallowed by a widened chunk
                continue
            width = overlap
            while True:
                theirs = set(right[0])
                shared = next((i for i, p in enumerate(left[0]) if span[0] <= p <= end - GUARD and p >= proven and p in theirs and _plain(text, p)), None)
                if shared is not None:
                    first = next(i for i, p in enumerate(left[0]) if p >= proven)
                    total += left[1][shared] - left[1][first]
                    proven = left[0][shared]
                    left, end = right, span[1]
                    break
                width *= 2
                end = min(span[1], end + width)
                left = _encoded(tok, text, [(proven, end)])[0]
                if end == span[1]:
                    break
    starts, before = left
    first = next((i for i, p in enumerate(starts) if p >= proven), len(starts))
    return total + before[-1] - before[first]


def token_counts(docs: DataFrame, path: str, limit: int, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row's whole text."""
    source = docs.select(*carried(keep, ["n_bytes", "n_tokens", "over_limit"]), text_or_empty(text).alias("__text"))
    keep = tuple(source.columns[:-1])
    schema = T.StructType([source.schema[k] for k in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(batches):
        encoder = chunk_encoder(path)
        for batch in batches:
            sizes, tokens = [], []
            for block in blocks(column_texts(batch, "__text")):
                sizes += [len(t.encode()) for t in block]
                if len(block) == 1 and len(block[0]) > CHUNK_CHARS:
                    tokens.append(count_huge(path, block[0]))
                    continue
                huge = {i for i, t in enumerate(block) if len(t) > CHUNK_CHARS}
                for i, ids in enumerate(encoder.encode(["" if i in huge else t for i, t in enumerate(block)])):
                    tokens.append(count_huge(path, block[i]) if i in huge else len(ids) // 4)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return source.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
