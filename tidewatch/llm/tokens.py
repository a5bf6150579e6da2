"""Exact token ids of the word-level vocabulary, with a bounded cache of white-space chunks.

The vocabulary's normaliser turns runs of white space into one space and its splitter drops white
space, so a space, tab or newline always ends a split: the ids of a text are the ids of its chunks
in order. Each worker process keeps a cache from chunk to ids, bounded in bytes; what is not in it is encoded
by the library itself, and a full cache starts again, so results never differ. Chunks of more than ``KEPT_CHARS``
characters (texts without white space, base64, minified code) are never kept: they live as long as their block.
Texts that hold ``<|`` may hold an added token, which is found before splitting; they go to the
library whole.
"""

from __future__ import annotations

import functools
import itertools
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a worker's cache holds at most (by :func:`entry_bytes`), the longest chunk it keeps, and characters of text taken at a time.
CACHE_BYTES = 160_000_000
KEPT_CHARS = 64
BLOCK_CHARS = 2_000_000

#: Signs that may stand behind the letters of a chunk without changing how these are split.
TAIL_SIGNS = ".,;:!?#*%&$"


def entry_bytes(keys: Iterable[str], value_bytes: int) -> int:
    """What new cache entries take, estimated from above: objects, slots and places, four bytes a character, and the values."""
    sizes = [len(k) for k in keys]
    return 200 * len(sizes) + 4 * sum(sizes) + value_bytes


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer of this process; no truncation, no padding, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def blocks(texts: Iterable[str], limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``limit`` characters; a longer text stands alone."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def gathered(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[r] : starts[r + 1]]`` of all ``rows`` behind one another, and their sizes."""
    first = starts[rows]
    sizes = starts[rows + 1] - first
    ends = np.cumsum(sizes)
    at = np.repeat(first - ends + sizes, sizes)
    at += np.arange(len(at))
    return flat[at], sizes


def totals(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` sizes."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def parted(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Consecutive parts of these sizes."""
    ends = np.cumsum(sizes)
    return [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class RunCache:
    """Ids of chunks as runs of one flat array; ``cache`` maps a chunk to its run, and holds at most ``limit`` bytes between blocks.

    A block's chunks are numbered by Arrow, so that each different one is looked up once. What is not there
    is left to :meth:`learn`, which puts at least these chunks into the cache by :meth:`add`.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.held = 0  # bytes of the cache
        self.flat = np.empty(1 << 12, np.uint32)
        self.starts = np.zeros(1 << 10, np.int64)
        self.fresh: list[str] = []  # chunks added by this block

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put chunks that are not there yet, with their ids behind one another."""
        n, used = len(self.cache), int(self.starts[len(self.cache)])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[:used], np.empty(used + 2 * len(ids), np.uint32)))
        if n + len(keys) >= len(self.starts):
            self.starts = np.concatenate((self.starts[: n + 1], np.zeros(n + 2 * len(keys), np.int64)))
        self.flat[used : used + len(ids)] = ids
        np.cumsum(sizes, out=self.starts[n + 1 : n + 1 + len(keys)])
        self.starts[n + 1 : n + 1 + len(keys)] += used
        self.cache.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.fresh += keys

    def runs(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.cache.__getitem__, keys), np.int64, len(keys))

    def learn(self, missing: list[str]) -> None:
        raise NotImplementedError

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks behind one another, and the number of each chunk's."""
        coded = chunks.dictionary_encode()
        different = listed(coded.dictionary)
        if self.held > self.limit:
            self.clear()
        n, used = len(self.cache), int(self.starts[len(self.cache)])
        self.fresh = []
        try:
            runs = np.fromiter(map(self.cache.get, different, itertools.repeat(-1)), np.int64, len(different))
            unknown = np.flatnonzero(runs < 0)
            missing = list(map(different.__getitem__, unknown.tolist()))
            self.learn(missing)
            runs[unknown] = self.runs(missing)
            return gathered(self.flat, self.starts, runs[coded.indices.to_numpy()])
        finally:
            kept = [c for c in self.fresh if len(c) <= KEPT_CHARS]
            if len(kept) < len(self.fresh):
                ids, sizes = gathered(self.flat, self.starts, self.runs(kept))
                for chunk in self.fresh:
                    del self.cache[chunk]
                self.flat = self.flat[:used].copy()
                self.starts = self.starts[: n + 1].copy()
                self.add(kept, ids, sizes)
            self.held += entry_bytes(kept, 8 * (int(self.starts[len(self.cache)]) - used))


class ChunkEncoder(RunCache):
    """32-bit ids of texts."""

    def __init__(self, path: str):
        super().__init__(CACHE_BYTES)
        self.tok = tokenizer(path)
        ends = [t.endswith("</w>") for t, _ in sorted(self.tok.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends, dtype=bool)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for i in range(0, len(texts), 8192) for e in self.tok.encode_batch_fast(texts[i : i + 8192], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only: each is one split, whose last id alone ends a word."""
        found = [(np.empty(0, np.uint32), np.empty(0, np.int64))]
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            found.append((ids, sizes) if len(sizes) == len(part) else self._library(part))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def learn(self, missing: list[str]) -> None:
        """Put chunks into the cache: letters with other signs behind from their two parts, others whole.

        The splitter ends a run of letters at any other sign but an apostrophe, so the ids of the two parts are those of
        the whole. The letters themselves are kept too: they come with other signs or capitals.
        """
        chunks, cores, tails, words, other = [], [], [], [], []
        for chunk in missing:
            core = chunk.rstrip(TAIL_SIGNS)
            if core.isalpha() and (core.isascii() or (len(core.lower()) == len(core) and unicodedata.is_normalized("NFC", core))):
                word = core.lower() if core.isascii() else core  # the normaliser lowers letters itself
                words.append(word)
                if word != chunk:
                    chunks.append(chunk)
                    cores.append(word)
                    tails.append(chunk[len(core) :])
            else:
                other.append(chunk)
        words = [w for w in set(words) if w not in self.cache]
        self.add(words, *self._words(words))
        whole = [t for t in set(tails) if t not in self.cache]
        whole += set(other).difference(whole)
        self.add(whole, *self._library(whole))
        parts = np.stack((self.runs(cores), self.runs(tails)), axis=1)
        ids, sizes = gathered(self.flat, self.starts, parts.ravel())
        self.add(chunks, ids, sizes.reshape(-1, 2).sum(axis=1))

    def text_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, whole texts, and the number of each text's."""
        special = [i for i, t in enumerate(texts) if "<|" in t]
        plain = [t.replace("\n", " ").replace("\t", " ") for t in texts]
        for i in special:
            plain[i] = ""
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        ids, sizes = self.chunk_ids(lists.flatten())
        sizes = totals(sizes, lists.value_lengths().to_numpy())
        if special:
            cuts = parted(ids, sizes)
            for i in special:
                cuts[i], _ = self._library([texts[i]])
                sizes[i] = len(cuts[i])
            ids = np.concatenate(cuts)
        return ids, sizes

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes, in order."""
        ids, sizes = self.text_ids(texts)
        return (part.tobytes() for part in parted(ids.astype("<u4", copy=False), sizes))


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    return ChunkEncoder(path)


def column_texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a column; null is empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
