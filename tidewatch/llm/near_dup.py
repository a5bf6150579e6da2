"""Operator 4, near-duplicate classes by ProbMinHash, banding and verification.

Shingles are runs of five words (white space divides, lower case; a shorter text is one shingle),
weighted by how often they occur in their text.

1. Equal texts collapse by 128-bit hash to their smallest doc_id, before anything else is joined.
2. Each shingle is a Poisson process with its share of the text as rate: arrivals fall on registers
   by hash, and a register keeps the shingle that came first. A shingle is given up as soon as its
   next arrival is later than every register's first. Two texts agree in a register with the
   probability Jaccard similarity of their weighted shingles.
3. Bands of registers put texts into buckets. Within a bucket every text is verified against the
   smallest one, by exact shingles of the whole texts; links give classes (large star, small star).
4. A bucket that still holds several classes is looked at again: its texts of different classes are
   compared by exact shingles, in blocks of bounded size, and only links that join classes come out. So
   every pair of texts that share a bucket is either in one class or has been compared. Buckets with the
   same members are looked at once. No step emits the pairs within a group, and none has a cap.

A link needs a similarity of at least 0.8, as probability Jaccard of weighted shingles or as plain
Jaccard of the sets of shingles. Candidates come from weighted registers only, so that they share a band
is guaranteed (see the parameters) for probability Jaccard alone: texts that differ in how often a passage
is repeated can have plain Jaccard above 0.8 and still never be compared. Links go through keyed joins on both sides of which Spark can
split hot keys; the verifier streams rows, holding one text's shingles at a time.

Defined results: null counts as empty, and all texts without words are copies of each other.
Repeated rows are copies. Rows sharing a doc_id but not the text are taken as one document with
several texts. Rows without doc_id get the class of an equal text, or null. Extra columns do not matter.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import carried, stored, text_or_empty
from tidewatch.llm.tokens import KEPT_CHARS, blocks, column_texts, entry_bytes

#: Production parameters. A pair at 0.8 of probability Jaccard misses all bands with probability 6e-5.
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BLOCK_CHARS = 4_000_000
LEADER_SALTS = 1024
BLOCK_DOCS = 1024
CACHE_BYTES = 100_000_000
#: Bytes of a register: labels of 32 bits, so that short texts, which fill all registers with one label, hardly ever share one by chance.
LABEL = 4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _word_cache() -> dict:
    """Hashes of words; under the key None the bytes that the others take."""
    return {None: 0}


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of all shingles of a text, in order, with repetitions."""
    words = text.lower().split()
    cache = _word_cache()
    missing = set(words).difference(cache)
    if cache[None] > CACHE_BYTES:
        cache.clear()
        cache[None] = 0
        missing = set(words)
    for word in missing:
        cache[word] = xxhash.xxh3_64_intdigest(word)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    for word in [w for w in missing if len(w) > KEPT_CHARS]:
        missing.discard(word)
        del cache[word]
    cache[None] += entry_bytes(missing, 0)
    size = min(SHINGLE, len(h)) or 1
    if not len(h):
        return np.zeros(1, dtype=np.uint64)
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = out * GOLDEN + h[i : len(h) - size + 1 + i]
    return _mix(out)


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a text, sorted, and their shares of it."""
    kinds, counts = np.unique(shingles(text), return_counts=True)
    return kinds, counts / counts.sum()


def signatures(texts: list[str], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (32 bits each) of some texts at once; one row for each text."""
    parts = [weighted(t) for t in texts]
    n = len(parts)
    h = np.concatenate([k for k, _ in parts])
    rate = np.concatenate([w for _, w in parts])
    doc = np.repeat(np.arange(n), [len(k) for k, _ in parts])
    first = np.full(n * registers, np.inf)
    sig = np.zeros(n * registers, dtype=np.uint32)
    label = (_mix(h ^ GOLDEN) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    time = np.zeros(len(h))
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(h):
            z = _mix(h + step * GOLDEN)
            step += np.uint64(1)
            time = time - np.log(((z >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / rate
            at = doc * registers + ((_mix(z) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            sooner = np.flatnonzero(time < first[at])
            np.minimum.at(first, at[sooner], time[sooner])
            won = sooner[first[at[sooner]] == time[sooner]]
            sig[at[won]] = label[won]
            # early termination: later arrivals of these cannot be first anywhere
            going = time < first.reshape(n, registers).max(axis=1)[doc]
            h, rate, doc, label, time = h[going], rate[going], doc[going], label[going], time[going]
    return sig.reshape(n, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity: sum over shared x of 1 / sum over y of max(p_y / p_x, q_y / q_x), by sorted ratios."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    p, q = a[1][i], b[1][j]
    order = np.argsort(p / q)
    p, q = p[order], q[order]
    # y with a ratio above x's count with p_y, the others with q_y; those in one text only always count
    above = (1.0 - p.sum()) + np.concatenate([np.cumsum(p[::-1])[::-1][1:], [0.0]])
    below = (1.0 - q.sum()) + np.cumsum(q)
    return float((1.0 / (above / p + below / q)).sum())


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], limit: float = SIMILARITY) -> bool:
    small, large = sorted((len(a[0]), len(b[0])))
    shared = len(np.intersect1d(a[0], b[0], assume_unique=True))
    if shared >= limit * (small + large - shared) - 1e-9:
        return True
    return probability_jaccard(a, b) >= limit - 1e-9


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, t1, t2, sig, chars, kept): text hashes, registers and length of each row, and a struct of the columns ``keep``."""
    kept = F.struct(*carried(keep, ["class_id", "n_equal"])) if keep else F.lit(None).cast("boolean")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("__text"), kept.alias("kept"))
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in ("doc_id", "t1", "t2")], T.StructField("sig", T.BinaryType()), T.StructField("chars", T.LongType()), source.schema["kept"]])

    def made(batches):
        for batch in batches:
            t1, t2, sigs, chars = [], [], [], []
            for block in blocks(column_texts(batch, "__text")):
                for i in range(0, len(block), BLOCK_DOCS):
                    part = block[i : i + BLOCK_DOCS]
                    for t in part:
                        digest = xxhash.xxh3_128_digest(t.encode())
                        t1.append(int.from_bytes(digest[:8], "little", signed=True))
                        t2.append(int.from_bytes(digest[8:], "little", signed=True))
                    sigs += [row.tobytes() for row in signatures(part)]
                    chars += map(len, part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(chars, pa.int64()), batch.column(2)], names=["doc_id", "t1", "t2", "sig", "chars", "kept"])

    return source.mapInArrow(made, schema)


def _banded(texts: DataFrame) -> DataFrame:
    """(bucket, id): one row for each band of each text."""
    width = LABEL * ROWS
    rows = texts.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    return rows.select(F.xxhash64("band", F.expr(f"substring(sig, band * {width} + 1, {width})")).alias("bucket"), "id")


def _groups(batches, size: int):
    """Rows of consecutive equal first ``size`` columns, as they stream in: (key, row) pairs."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            yield row[:size], row[size:]


def _one_each(docs: DataFrame, twice: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the rows of ``docs``, once for each different text of an id; ``twice`` are the ids that have several rows, and
    only their rows are grouped, with partial sums where they lie."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    again = rows.join(twice, "id", "left_semi").groupBy("id", F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text")).select("id", "text")
    return rows.join(twice, "id", "left_anti").unionByName(again)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are alike; ``texts`` are (id, text). Each a is sent once for each salt, each b once for each pair."""
    salted = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(LEADER_SALTS)).cast("int").alias("salt"), "b")
    wanted = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id")).unionByName(
        salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"))
    )
    rows = wanted.join(texts.hint("merge"), "id").select("a", "salt", "role", "id", "text")

    def checked(batches):
        held, leaders = None, []
        a_out: list[int] = []
        b_out: list[int] = []
        for k, (role, other, text) in _groups(batches, 2):
            if k != held:
                held, leaders = k, []
            this = weighted(text)
            if role == 0:
                leaders.append(this)
            elif any(alike(x, this) for x in leaders):
                a_out.append(k[0])
                b_out.append(other)
            if len(a_out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.mapInArrow(checked, "a long, b long").distinct()


def components(links: DataFrame, purpose: str = "classes") -> DataFrame:
    """(id, root) of every linked id, root the smallest of its class: alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), purpose)
    size = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), purpose)
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("u <> v").distinct()
        large = stored(large, purpose)  # v > u throughout
        least = stored(large.groupBy("v").agg(F.min("u").alias("m")), purpose)
        small = large.join(least, "v").select(F.col("u").alias("x"), "m").where("x <> m").unionByName(least.select(F.col("v").alias("x"), "m"))
        edges = stored(small.select(F.col("x").alias("v"), F.col("m").alias("u")).distinct(), purpose)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (now["n"], now["h"]) == size:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("root"))
        size = (now["n"], now["h"])


def _links(rows: list[tuple]) -> list[tuple[int, int]]:
    """Exact links between the texts of a group, (block, id, root, text) each; classes joined on the way
    are not compared again, so there are fewer links than texts.

    Where a shingle repeats, probability Jaccard decides, and it is at most the weight that two texts have in common:
    each shared shingle adds the inverse of a sum of which one term is the inverse of its smaller weight. Only pairs whose
    common weight reaches the limit are worked out, and no pair that is alike can fall below it."""
    parts = [weighted(r[3]) for r in rows]
    sizes = np.array([len(k) for k, _ in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    vocabulary, tokens = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    lumpy = np.array([w[0] != w[-1] or w.min() != w.max() for _, w in parts])
    weights = np.concatenate([w for _, w in parts])
    block = np.array([r[0] for r in rows])
    crossing = len(set(block.tolist())) > 1
    root = np.unique(np.array([r[2] for r in rows], dtype=np.int64), return_inverse=True)[1]
    out = []
    held = np.zeros(len(vocabulary), dtype=bool)
    mass = np.zeros(len(vocabulary))
    for x in range(len(rows) - 1):
        open_to = root[x + 1 :] != root[x]
        if crossing:  # pairs within one block are compared where that block stands alone
            open_to &= block[x + 1 :] != block[x]
        if not open_to.any():
            continue
        mine = tokens[starts[x] : starts[x + 1]]
        held[mine] = True
        shared = np.add.reduceat(held[tokens[starts[x + 1] :]], starts[x + 1 : -1] - starts[x + 1], dtype=np.int64)
        held[mine] = False
        near = shared >= SIMILARITY * (sizes[x] + sizes[x + 1 :] - shared) - 1e-9
        # weights matter only where a shingle repeats
        unsure = open_to & ~near & (lumpy[x] | lumpy[x + 1 :])
        if unsure.any():
            mass[mine] = parts[x][1]
            common = np.add.reduceat(np.minimum(mass[tokens[starts[x + 1] :]], weights[starts[x + 1] :]), starts[x + 1 : -1] - starts[x + 1])
            mass[mine] = 0.0
            for y in np.flatnonzero(unsure & (common >= SIMILARITY - 1e-9)):
                near[y] = root[x] != root[x + 1 + y] and probability_jaccard(parts[x], parts[x + 1 + y]) >= SIMILARITY - 1e-9
        for y in np.flatnonzero(near & open_to) + x + 1:
            if root[x] != root[y]:
                root[root == root[y]] = root[x]
                out.append((min(rows[x][1], rows[y][1]), max(rows[x][1], rows[y][1])))
    return out


def _again(members: DataFrame, texts: DataFrame, whole: DataFrame) -> DataFrame:
    """Links between different classes that share a bucket, by exact shingles, in blocks of bounded size."""
    sized = members.join(texts.select("id", "chars"), "id")
    mixed = sized.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low <> high")
    once = stored(mixed.groupBy("n", "who").agg(F.min_by(F.struct("bucket", "chars"), "bucket").alias("b")).select("b.*"), "mixed")
    parts = F.greatest(F.ceil(F.col("chars") / F.lit(BLOCK_CHARS)), F.lit(1)).cast("int")
    rows = members.join(once.select("bucket", parts.alias("nb")), "bucket")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "root")
    rows = rows.join(whole.hint("merge"), "id").select("bucket", "i", "j", "mine", "id", "root", "text")

    def compared(batches):
        def flush(rows):
            found = _links(rows)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        held, group = None, []
        for k, row in _groups(batches, 3):
            if k != held:
                if len(group) > 1:
                    yield flush(group)
                held, group = k, []
            group.append(row)
        if len(group) > 1:
            yield flush(group)

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    return dealt.mapInArrow(compared, "a long, b long").distinct()


def classes(docs: DataFrame, keep: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's doc_id (or columns ``keep`` in its place), its ``class_id`` (the smallest doc_id of the class) and the
    number of equal texts ``n_equal``; a document is its class's representative if both ids are equal."""
    made = stored(features(docs, key, text, keep), "features")
    twice = stored(made.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    rows = _one_each(docs, twice, key, text)
    texts = stored(made.groupBy("t1", "t2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("chars").alias("chars"), F.count("*").alias("n_equal")), "texts")
    known = texts.where("id is not null")
    banded = _banded(known)
    # buckets of several texts, with the smallest of each; then its members meet it
    shared = stored(banded.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("bucket", "a"), "buckets")
    members = stored(banded.join(shared, "bucket").select("bucket", "a", "id").distinct(), "members")
    stars = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = stored(verify(stars, rows), "links")
    found = components(links)
    rooted = members.join(found, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    links = stored(links.unionByName(_again(rooted, known, rows)), "links")
    found = components(links)
    whole = stored(texts.join(found, "id", "left").select("t1", "t2", F.coalesce("root", "id").alias("class_id"), "n_equal"), "classes")
    own = made.select("doc_id", "t1", "t2", "kept").join(whole, ["t1", "t2"])
    return own.select("kept.*" if keep else "doc_id", "class_id", "n_equal")
