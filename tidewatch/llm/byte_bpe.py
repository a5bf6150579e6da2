"""Operator 9, byte-level BPE by prefix dynamic programming, and decoding.

For each prefix of a piece of text there is exactly one token that the encoding of that prefix ends
with. :class:`PrefixEncoder` stores it: going from left to right, the last token of prefix ``i`` is
the one token ``t`` ending there such that the last token of the prefix before it and ``t`` stand
next to each other in a real encoding, that is, their joined bytes encode to just these two.
Walking back from the end gives the encoding. Since a prefix's entry never changes, text can be
appended exactly by going on from the stored entries, and an edit needs only the entries behind it.

Ids are those of merging by rank; each match of the pattern is encoded separately, no special tokens.
Defined results: null and empty texts have no ids and decode to nothing; repeated rows each count.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import carried, text_or_empty
from tidewatch.llm.tokens import RunCache, blocks, column_texts, gathered, parted, totals

#: What a worker's caches hold at most: bytes of text chunks and their ids, and pairs of tokens. Longer chunks than ``KEPT_CHARS`` are never kept.
CACHE_BYTES = 300_000_000
CACHE_PAIRS = 1_000_000
#: Unicode's White_Space, which the pattern's ``\s`` means.
WHITE = "\t-\r \x85\xa0  -     　"


class PrefixEncoder:
    """Last tokens of byte prefixes for one vocabulary of ranks; an entry is a token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sizes = {v: len(k) for k, v in ranks.items()}
        self.pairs: dict[int, dict[int, bool]] = {}  # by the second token, then by the first
        self.n_pairs = 0
        # States stand for the longest end of the bytes read that begins a token. They and their steps are made when met.
        self.begins = {token[:i] for token in ranks for i in range(len(token) + 1)}
        self.states: dict[bytes, int] = {}
        self.ends: list[bytes] = []
        self.chains: list[list[tuple[int, int, dict[int, bool]]]] = []
        self.steps: dict[int, int] = {}
        self.state(b"")

    def merged(self, data: bytes) -> list[bytes]:
        """Merging by rank, for short strings: it decides which tokens may stand together."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = self.ranks.get, len(self.ranks) + 1
        joined = [get(data[i : i + 2], none) for i in range(len(data) - 1)]  # rank of each part with the next
        while joined:
            best = min(joined)
            if best == none:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def state(self, end: bytes) -> int:
        """The state of an end of what was read, with the tokens it ends with, longest first, that are the encoding of
        their own bytes; some are never reached by merging."""
        found = self.states.get(end)
        if found is None:
            found = self.states[end] = len(self.ends)
            self.ends.append(end)
            tokens = [self.ranks.get(end[i:]) for i in range(len(end))]
            alone = [t for t in tokens if t is not None and len(self.merged(self.tokens[t])) == 1]
            self.chains.append([(self.sizes[t], t, self.pairs.setdefault(t, {})) for t in alone])
        return found

    def step(self, state: int, byte: int) -> int:
        """The state behind one more byte."""
        end = self.ends[state] + bytes((byte,))
        while end not in self.begins:
            end = end[1:]
        if len(self.steps) >= CACHE_PAIRS:
            self.steps.clear()
        found = self.steps[state << 8 | byte] = self.state(end)
        return found

    def beside(self, a: int, b: int) -> bool:
        """Whether ``b`` can follow ``a``: their joined bytes encode to these two."""
        if self.n_pairs >= CACHE_PAIRS:
            for known in self.pairs.values():
                known.clear()
            self.n_pairs = 0
        left, right = self.tokens[a], self.tokens[b]
        fits = self.pairs[b][a] = self.merged(left + right) == [left, right]
        self.n_pairs += 1
        return fits

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Entries for all prefixes of ``data``; ``last`` holds those of its first prefixes already.

        ``last[i]`` is the last token of the first ``i + 1`` bytes, so appending is exact. No state reaches further
        back than the longest token.
        """
        steps, chains, done, state = self.steps, self.chains, len(last), 0
        for byte in data[max(0, done - self.longest) : done]:
            to = steps.get(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
        for end in range(done, len(data)):
            byte = data[end]
            to = steps.get(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
            for length, token, known in chains[state]:
                if length > end:
                    break
                before = last[end - length]
                fits = known.get(before)
                if self.beside(before, token) if fits is None else fits:
                    break
            else:
                raise ValueError("no token ends this prefix: the vocabulary lacks a byte")
            last.append(token)
        return last

    def edited(self, last: list[int], old: bytes, new: bytes) -> list[int]:
        """Entries of ``new``, keeping those before its first difference from ``old``."""
        return self.extend(last[: len(os.path.commonprefix((old, new)))], new)

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that the entries hold."""
        out, end, sizes = [], len(last), self.sizes
        while end:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def prefix_encoder(path: str) -> PrefixEncoder:
    """One encoder for each worker process and vocabulary file."""
    with open(path, "rb") as file:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})


class TextEncoder(RunCache):
    """Ids of whole texts: the pattern splits, prefixes encode, and frequent chunks are kept.

    Where no two white-space characters are neighbours, one of them always starts a match: a space
    goes with the word behind it, any other stands alone. Such texts are cut there by a plain
    expression, and each different chunk is split by the pattern and encoded once.
    """

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        super().__init__(CACHE_BYTES)
        self.prefixes = prefix_encoder(path)
        self.pattern = regex.compile(pattern.replace(r"\s\p", rf"{WHITE}\p").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.chunks = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]")
        self.double = re.compile(rf"[{WHITE}][{WHITE}]")
        said = [f"{i},".encode() if i in self.prefixes.tokens else b"" for i in range(max(self.prefixes.tokens) + 1)]
        self.decimals = runs_of(said)
        self.bytes = runs_of([self.prefixes.tokens.get(i, b"") for i in range(len(said))])

    def pieces(self, text: str) -> list[str]:
        return self.chunks.findall(text) if self.double.search(text) is None else self.pattern.findall(text)

    def learn(self, missing: list[str]) -> None:
        """Encode chunks; in sorted order a match goes on from the entries of its common prefix with the last."""
        prefixes = self.prefixes
        split = list(map(self.pattern.findall, missing))
        fresh = sorted({m.encode() for found in split for m in found if m not in self.cache})
        ids, sizes = array("I"), []
        last: list[int] = []
        old = b""
        for data in fresh:
            last = prefixes.edited(last, old, data)
            old = data
            found = prefixes.walk(last)
            ids.extend(found)
            sizes.append(len(found))
        self.add([m.decode() for m in fresh], np.frombuffer(ids, np.uint32), np.array(sizes, np.int64))
        several = [i for i, found in enumerate(split) if len(found) > 1]
        found, sizes = gathered(self.flat, self.starts, self.runs([m for i in several for m in split[i]]))
        self.add([missing[i] for i in several], found, totals(sizes, np.array([len(split[i]) for i in several], np.int64)))

    def text_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and the number of each text's."""
        split = [self.pieces(text) for text in texts]
        ids, sizes = self.chunk_ids(pa.array(list(itertools.chain.from_iterable(split)), pa.large_string()))
        return ids, totals(sizes, np.fromiter(map(len, split), np.int64, len(split)))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        ids, sizes = self.text_ids(texts)
        return (part.tolist() for part in parted(ids, sizes))

    def digests(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[str], list[str]]:
        """For each text the digests of its ids, as decimals joined by commas, and of the bytes that they decode to."""
        out = []
        for table, behind in ((self.decimals, 1), (self.bytes, 0)):
            data, lengths = gathered(*table, ids)
            out.append([hashlib.sha256(part[: max(0, len(part) - behind)]).hexdigest() for part in parted(data, totals(lengths, sizes))])
        return out[0], out[1]


def runs_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in strings])))


@functools.lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens, the digests of ids and of the decoded bytes, and the ids if asked for. A kept
    column named as one of these comes out with ``_in`` behind it."""
    source = docs.select(*carried(keep, ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]), text_or_empty(text).alias("__text"))
    keep = tuple(source.columns[:-1])
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    extra += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    names = [*keep, *[f.name for f in extra]]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def both(batches):
        encoder = text_encoder(path, pattern)
        for batch in batches:
            columns: list[list] = [[] for _ in extra]
            for block in blocks(column_texts(batch, "__text")):
                ids, sizes = encoder.text_ids(block)
                found = [sizes.tolist(), *encoder.digests(ids, sizes)]
                if with_ids:
                    found.append(parted(ids, sizes))
                for column, values in zip(columns, found, strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], names=names)

    return source.mapInArrow(both, T.StructType([source.schema[k] for k in keep] + extra))
