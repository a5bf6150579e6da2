"""Operator 12, hard-negative mining: dual-tree search for exact inner products.

Two trees meet. The upper levels are one splitting tree over the space, fitted on a bounded sample (``SAMPLE_ROWS``); every row, anchor or
candidate, gets the leaf (cell) it falls into, and the centre distances of all rows give each cell a ball. Anchors are grouped by the largest
subtrees of at most ``GROUP_ROWS`` anchors, candidates by those of at most ``rows / parallelism`` rows (``BLOCK_ROWS`` bound it from both sides); a cell that
holds more is split by hash, so groups and blocks are bounded also where a third of all rows are equal. A tile is one anchor group and one candidate block.
Inside a tile both sides grow their own tree of balls with exact label ranges, and pairs of nodes are searched best bound
first: for balls with centres a, b and radii r, s every inner product lies within ``a.b`` plus or minus ``r|b| + s|a| + rs``, so a pair goes when no
anchor of the node can still want a score from that interval, whole groups at once. Leaf pairs are scored exactly.

1. Positives: of the rows of its own label each anchor keeps the best by (score, smaller id), tile by tile, then over all tiles.
2. Negatives: each positive asks for the best rows of other labels with ``low * positive <= 100 * score <= high * positive``. Cell
   pairs whose interval holds no wanted score, for any anchor of the cell, are never put into a tile.

Every candidate goes to the groups of anchors and every anchor to the blocks, as in a blocked matrix product; nothing is broadcast but the sample's tree and the
bounds of at most ``CELLS`` cells. In 64 random dimensions intervals overlap and little can be pruned; then each tile is a few matrix products.

Components are ``floor(256 * x)`` of doubles. Products are taken in doubles where they are exact (bounds proven from the data of a tile),
else in Python's integers; scores beyond a long are compared exactly within a tile, but
given as the nearest long, and the range that a positive asks for follows from what is given.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; shorter vectors count as
filled with zeros; each row counts, so a repeated row is another row with the same id, and an anchor that is there n times
gives its result n times; ties go to the smaller id; an anchor without a positive or without a negative in range gives no row; an empty
table gives none. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import stored

#: Production parameters.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
SCALE = 256
SAMPLE_ROWS, CELLS = 2048, 64
GROUP_ROWS, BLOCK_ROWS = 16_384, (1024, 65_536)
LEAF_ROWS = (64, 512)
LONG = 2**63 - 1


def take_part(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, relabelled by the contract's rule; v as stored."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(usable)
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").alias("v"))


# --- vectors -------------------------------------------------------------------------------------------------------------


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def units(x: np.ndarray) -> np.ndarray:
    """``floor(256 * x)``; doubles where these hold it, Python integers where 256 * x is beyond them."""
    with np.errstate(over="ignore"):
        out = np.floor(SCALE * x)
    if np.isfinite(out).all():
        return out
    return np.array([[math.floor(v) * SCALE if abs(v) > 2.0**60 else math.floor(v * SCALE) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def doubles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` as doubles for bounds, and which rows hold a value too large for that; no ball holds these."""
    if x.dtype != object and np.abs(x).max(initial=0.0) < 1e100:
        return x, np.zeros(len(x), dtype=bool)
    out = np.array([[float(max(-(10**100), min(10**100, v))) for v in row] for row in x.tolist()]).reshape(x.shape)
    return out, (np.abs(out) >= 1e100).any(axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold every product and sum of the two sides."""
    if a.dtype == object or b.dtype == object:
        return False
    largest = lambda x: float(np.abs(x).max(initial=0.0))
    return largest(a) * largest(b) * max(1, a.shape[1]) < 2.0**53


def products(a: np.ndarray, b: np.ndarray, safe: bool) -> np.ndarray:
    if safe:
        return a @ b.T
    whole = lambda x: x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


# --- trees inside a tile -------------------------------------------------------------------------------------------------


@dataclass(eq=False)
class Node:
    """Rows of ``order[start:stop]``, the ball that holds them, and their smallest and largest label."""

    start: int
    stop: int
    centre: np.ndarray
    radius: float
    low: int
    high: int
    children: tuple[Node, ...] = ()


class Tree:
    """Splits by label first, then across the longest of a few directions, down to leaves of ``leaf`` rows."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        (self.x, self.huge), self.labels = doubles(x), labels
        self.order = np.argsort(labels, kind="stable")
        self.leaf = leaf
        self.root = self._node(0, len(x))

    def _node(self, start: int, stop: int) -> Node:
        rows = self.order[start:stop]
        own, labels = self.x[rows], self.labels[rows]
        centre = own.mean(axis=0)
        away = np.sqrt(np.square(own - centre).sum(axis=1))
        radius = math.inf if self.huge[rows].any() else float(away.max()) * (1 + 1e-9)
        node = Node(start, stop, centre, radius, int(labels.min()), int(labels.max()))
        if stop - start <= self.leaf:
            return node
        if node.low != node.high:  # rows are in order of label
            cut = int(np.searchsorted(labels, labels[(stop - start) // 2]))
            cut = cut or int(np.searchsorted(labels, labels[0], side="right"))
        elif node.radius > 0:
            first = own[away.argmax()]
            other = own[np.square(own - first).sum(axis=1).argmax()]
            self.order[start:stop] = rows[np.argsort(own @ (other - first), kind="stable")]
            cut = (stop - start) // 2
        else:
            cut = (stop - start) // 2
        node.children = (self._node(start, start + cut), self._node(start + cut, stop))
        return node


def interval(a: Node, b: Node) -> tuple[float, float]:
    """Bounds of every inner product between the rows of two nodes, widened by what rounding may cost."""
    if not math.isfinite(a.radius + b.radius):
        return -math.inf, math.inf
    mid = float(a.centre @ b.centre)
    na, nb = math.sqrt(float(a.centre @ a.centre)), math.sqrt(float(b.centre @ b.centre))
    slack = a.radius * nb + b.radius * na + a.radius * b.radius
    slack += 1e-9 * (abs(mid) + slack + na * nb) + 1e-6
    return mid - slack, mid + slack


class Best:
    """For each of n questions the best k (score, smaller id) seen so far."""

    def __init__(self, n: int, k: int, whole: bool):
        kind = object if whole else np.float64
        self.score = np.full((n, k), -math.inf, dtype=kind)
        self.ids = np.full((n, k), LONG, dtype=np.int64)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Questions ``at`` see ``score`` (questions by rows; -inf where a row is not theirs) of rows ``ids``."""
        k = self.score.shape[1]
        worst = self.score[at, -1]
        hit = (score >= worst[:, None]) & (score > -math.inf)
        for i in np.flatnonzero(hit.any(axis=1)):
            found = np.flatnonzero(hit[i])
            s = score[i, found]
            if len(found) > 4 * k and s.dtype != object:  # all that reach the k-th best, ties included
                found = found[s >= np.partition(s, len(s) - k)[len(s) - k]]
                s = score[i, found]
            q = at[i]
            s = np.concatenate([self.score[q], s])
            d = np.concatenate([self.ids[q], ids[found]])
            best = sorted(range(len(s)), key=lambda j: (-s[j], d[j]))[:k]
            self.score[q], self.ids[q] = s[best], d[best]

    def rows(self) -> tuple[np.ndarray, ...]:
        """(question, score, id) of all that was found."""
        q, j = np.nonzero((self.score > -math.inf).astype(bool))
        return q, _longs(self.score[q, j]), self.ids[q, j]


def search(anchors: Tree, rows: Tree, wanted, leaves) -> None:
    """Visit pairs of nodes, highest bound first; ``wanted(anchor node, row node, low, high)`` prunes, ``leaves`` scores."""
    heap, n = [], 0

    def push(a: Node, b: Node) -> None:
        nonlocal n
        low, high = interval(a, b)
        if wanted(a, b, low, high):
            n += 1
            heapq.heappush(heap, (-high, n, low, a, b))

    push(anchors.root, rows.root)
    while heap:
        high, _, low, a, b = heapq.heappop(heap)
        if not wanted(a, b, low, -high):
            continue
        if not a.children and not b.children:
            leaves(a, b)
        elif a.children and (not b.children or a.stop - a.start >= b.stop - b.start):
            for child in a.children:
                push(child, b)
        else:
            for child in b.children:
                push(a, child)


def best_of_label(anchor_x, anchor_labels, row_x, row_labels, row_ids, k: int) -> Best:
    """The best ``k`` rows of each anchor's own label, itself included where it is among the rows."""
    safe = exact(anchor_x, row_x)
    left, right = Tree(anchor_x, anchor_labels, LEAF_ROWS[0]), Tree(row_x, row_labels, LEAF_ROWS[1])
    best = Best(len(anchor_x), k, not safe)

    def wanted(a: Node, b: Node, low: float, high: float) -> bool:
        return a.low <= b.high and b.low <= a.high and high >= best.score[left.order[a.start : a.stop], -1].min()

    def leaves(a: Node, b: Node) -> None:
        i, j = left.order[a.start : a.stop], right.order[b.start : b.stop]
        score = products(anchor_x[i], row_x[j], safe)
        best.offer(i, np.where(anchor_labels[i][:, None] == row_labels[j][None, :], score, -math.inf), row_ids[j])

    search(left, right, wanted, leaves)
    return best


def best_in_range(anchor_x, anchor_labels, floors: list, caps: list, owner: np.ndarray, row_x, row_labels, row_ids, k: int) -> Best:
    """For each question (a range of scores of anchor ``owner``) the best ``k`` rows of another label within it."""
    safe = exact(anchor_x, row_x)
    kind = np.float64 if safe else object
    floor, cap = np.array(floors, dtype=kind), np.array(caps, dtype=kind)
    left, right = Tree(anchor_x, anchor_labels, LEAF_ROWS[0]), Tree(row_x, row_labels, LEAF_ROWS[1])
    best = Best(len(owner), k, not safe)
    by = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[by], np.arange(len(anchor_x) + 1))
    of_node: dict[int, np.ndarray] = {}

    def questions(a: Node) -> np.ndarray:
        if id(a) not in of_node:
            of_node[id(a)] = np.concatenate([by[ends[i] : ends[i + 1]] for i in left.order[a.start : a.stop]])
        return of_node[id(a)]

    def wanted(a: Node, b: Node, low: float, high: float) -> bool:
        if a.low == a.high == b.low == b.high:
            return False
        q = questions(a)
        return bool(((high >= floor[q]) & (low <= cap[q]) & (high >= best.score[q, -1])).any())

    def leaves(a: Node, b: Node) -> None:
        i, j = left.order[a.start : a.stop], right.order[b.start : b.stop]
        score = np.where(anchor_labels[i][:, None] != row_labels[j][None, :], products(anchor_x[i], row_x[j], safe), -math.inf)
        place = {r: n for n, r in enumerate(i)}
        q = questions(a)
        own = score[[place[o] for o in owner[q]]]
        best.offer(q, np.where((own >= floor[q][:, None]) & (own <= cap[q][:, None]), own, -math.inf), row_ids[j])

    search(left, right, wanted, leaves)
    return best


# --- the upper levels ----------------------------------------------------------------------------------------------------


@dataclass
class Upper:
    """A complete binary tree of splits: normals and thresholds of its inner nodes in breadth-first order."""

    normals: np.ndarray
    thresholds: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, cells: int = CELLS) -> Upper:
        normals, thresholds = np.zeros((cells - 1, sample.shape[1])), np.zeros(cells - 1)
        rows = {0: np.arange(len(sample))}
        for node in range(cells - 1):
            own = sample[rows[node]]
            if len(own) > 1:
                far = own[np.square(own - own.mean(axis=0)).sum(axis=1).argmax()]
                normals[node] = own[np.square(own - far).sum(axis=1).argmax()] - far
                thresholds[node] = np.median(own @ normals[node])
            right = own @ normals[node] > thresholds[node]
            rows[2 * node + 1], rows[2 * node + 2] = rows[node][~right], rows[node][right]
        return Upper(normals, thresholds)

    def cell(self, x: np.ndarray) -> np.ndarray:
        width = self.normals.shape[1]
        x = np.pad(x[:, :width], ((0, 0), (0, max(0, width - x.shape[1]))))
        node = np.zeros(len(x), dtype=np.int64)
        while len(node) and node[0] < len(self.thresholds):  # the tree is complete: all rows are at one depth
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[node]) > self.thresholds[node])
        return node - len(self.thresholds)


def parts(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the subtree it is taken with, the largest of at most ``most`` rows, and into how many that part is split."""
    part, split = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)

    def cut(start: int, stop: int) -> None:
        total = int(counts[start:stop].sum())
        if total <= most or stop - start == 1:
            part[start:stop], split[start:stop] = start, max(1, -(-total // most))
        else:
            cut(start, (start + stop) // 2)
            cut((start + stop) // 2, stop)

    cut(0, len(counts))
    return part, split


def _placed(rows: DataFrame, upper: Upper, centres: np.ndarray) -> DataFrame:
    """Rows with their cell and their distance from its centre."""

    def place(batches):
        for batch in batches:
            x, huge = doubles(units(matrix(batch.column(2))))
            cell = upper.cell(x)
            width = max(x.shape[1], centres.shape[1])
            wide = lambda y: np.pad(y, ((0, 0), (0, width - y.shape[1])))
            away = np.where(huge, np.inf, np.sqrt(np.square(wide(x) - wide(centres)[cell]).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=["vec_id", "label", "v", "cell", "away"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    return rows.mapInArrow(place, schema)


def _map(values: list) -> F.Column:
    """A literal array indexed by cell, of at most CELLS entries."""
    return F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values])


def _split(part: np.ndarray, split: np.ndarray):
    """The (part, salt) key of a row, by its cell and a hash of its vector's id."""
    n = F.get(_map(split.tolist()), F.col("cell"))
    return F.struct(F.get(_map(part.tolist()), F.col("cell")).cast("long").alias("part"), F.pmod(F.xxhash64("vec_id", "v"), n).cast("long").alias("salt"))


def _targets(allowed: np.ndarray, part: np.ndarray, split: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each row of ``allowed`` (cells by cells of the other side) the (part, splits) it must meet."""
    return [sorted({(int(part[c]), int(split[c])) for c in np.flatnonzero(row)}) for row in allowed]


def _meet(df: DataFrame, targets: list[list[tuple[int, int]]], name: str) -> DataFrame:
    """One row for each (part, salt) of the other side that the row's cell must meet."""
    kinds = sorted({tuple(t) for t in targets})
    lists = F.array(*[F.array(*[F.struct(F.lit(p).alias("part"), F.lit(s).alias("splits")) for p, s in t]) if t else F.expr("cast(array() as array<struct<part:int,splits:int>>)") for t in kinds])
    own = F.get(_map([kinds.index(tuple(t)) for t in targets]), F.col("cell"))
    each = df.withColumn("__t", F.explode(F.get(lists, own)))
    each = each.withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__t.splits") - 1)))
    return each.withColumn(name, F.struct(F.col("__t.part").cast("long").alias("part"), F.col("__s").cast("long").alias("salt"))).drop("__t", "__s")


def _tiles(anchors: DataFrame, rows: DataFrame, allowed: np.ndarray, groups, blocks, find, schema: str) -> DataFrame:
    """``find`` over every tile of an anchor group and a block of rows; ``allowed``: anchors' cells by rows' cells."""
    left = _meet(anchors.withColumn("g", _split(*groups)), _targets(allowed, *blocks), "b")
    right = _meet(rows.withColumn("b", _split(*blocks)), _targets(allowed.T, *groups), "g").select("g", "b", "vec_id", "label", "v")
    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(find, schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


def _sides(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a, b = matrix(left["v"]), matrix(right["v"])
    width = max(a.shape[1], b.shape[1])
    return tuple(units(np.pad(x, ((0, 0), (0, width - x.shape[1])))) for x in (a, b))


def _entries(score: np.ndarray, ids: np.ndarray) -> pa.StructArray:
    """Entries that sort by score, higher first, then by id; the complement turns the order of longs without overflow."""
    return pa.StructArray.from_arrays([pa.array(~score, pa.int64()), pa.array(ids, pa.int64())], names=["down", "id"])


def _longs(values) -> np.ndarray:
    return np.array([max(-LONG - 1, min(LONG, int(v))) for v in values], dtype=np.int64)


def _positives(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    names = ["vec_id", "label", "vh", "own", "entry"]
    if not left.num_rows or not right.num_rows:
        return pa.Table.from_arrays([*[pa.array([], pa.int64())] * 4, _entries(np.zeros(0, np.int64), np.zeros(0, np.int64))], names=names)
    a, b = _sides(left, right)
    best = best_of_label(a, _numbers(left, "label"), b, _numbers(right, "label"), _numbers(right, "vec_id"), k)
    own = _longs((a * a).sum(axis=1) if exact(a, a) else (products(r[None], r[None], False)[0, 0] for r in a))
    q, score, ids = best.rows()
    return pa.Table.from_arrays([*[left[n].take(pa.array(q)).combine_chunks() for n in names[:3]], pa.array(own[q]), _entries(score, ids)], names=names)


def _negatives(left: pa.Table, right: pa.Table, k: int, low: int, high: int) -> pa.Table:
    names = ["vec_id", "label", "vh", "positive_score", "entry"]
    owner, asked, floors, caps = [], [], [], []
    for i, own in enumerate(left["positives"].to_pylist() if left.num_rows and right.num_rows else []):
        for p in sorted({x["score"] for x in own}):
            floor, cap = -(-low * p // 100), high * p // 100
            if floor <= cap:
                owner, asked, floors, caps = [*owner, i], [*asked, p], [*floors, floor], [*caps, cap]
    if not owner:
        return pa.Table.from_arrays([*[pa.array([], pa.int64())] * 4, _entries(np.zeros(0, np.int64), np.zeros(0, np.int64))], names=names)
    a, b = _sides(left, right)
    best = best_in_range(a, _numbers(left, "label"), floors, caps, np.array(owner), b, _numbers(right, "label"), _numbers(right, "vec_id"), k)
    q, score, ids = best.rows()
    at = pa.array(np.array(owner)[q])
    return pa.Table.from_arrays([*[left[n].take(at).combine_chunks() for n in names[:3]], pa.array(np.array(asked, dtype=np.int64)[q]), _entries(score, ids)], names=names)


def mine(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_every: int = ANCHOR_EVERY,
    group_rows: int = GROUP_ROWS, block_rows: tuple[int, int] = BLOCK_ROWS, cells: int = CELLS,
) -> DataFrame:
    """Hard negatives of ``rows`` (vec_id, label, v) for the anchors among them."""
    spark = rows.sparkSession
    drawn = rows.withColumn("h", F.xxhash64("vec_id", "v")).orderBy("h", "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
    sample = doubles(units(matrix(drawn["v"])))[0]
    upper = Upper.fit(sample, cells)
    own = upper.cell(sample)
    centres = np.array([sample[own == c].mean(axis=0) if (own == c).any() else np.zeros(sample.shape[1]) for c in range(cells)])
    placed = stored(_placed(rows, upper, centres), "op12-placed")
    is_anchor = F.col("vec_id") % anchor_every == 0
    counts, anchor_counts, radius, anchor_radius = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells)
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.count_if(is_anchor).alias("a"), F.max(F.when(is_anchor, F.col("away"))).alias("ar"))
    for r in held.collect():  # at most ``cells`` rows
        counts[r["cell"]], radius[r["cell"]], anchor_counts[r["cell"]], anchor_radius[r["cell"]] = r["n"], r["r"], r["a"], r["ar"] or 0.0
    groups = parts(anchor_counts, group_rows)
    blocks = parts(counts, min(block_rows[1], max(block_rows[0], -(-int(counts.sum()) // (4 * spark.sparkContext.defaultParallelism)))))
    present = (anchor_counts > 0)[:, None] & (counts > 0)[None, :]

    anchors = placed.where(is_anchor).groupBy("vec_id", "label", "v", "cell").agg(F.count("*").alias("times"))
    anchors = anchors.withColumn("vh", F.xxhash64("v"))
    key = ["vec_id", "label", "vh"]
    offered = _tiles(anchors, placed, present, groups, blocks, lambda a, b: _positives(a, b, positives + 1), "vec_id long, label long, vh long, own long, entry struct<down:long,id:long>")
    best = offered.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("entry"))).where(F.col("n") <= positives + 1)
    # An anchor meets itself: one entry with its own id and score goes, or else the last.
    best = best.groupBy(*key).agg(F.array_sort(F.collect_list("entry")).alias("all"), F.first("own").alias("own"))
    me = F.array_position("all", F.struct(F.bitwise_not("own").alias("down"), F.col("vec_id").alias("id")))
    others = F.when(F.col("me") > 0, F.filter("all", lambda x, i: i != F.col("me") - 1)).otherwise(F.slice("all", 1, positives))
    best = best.withColumn("me", me).select(*key, F.transform(others, lambda x: F.struct(F.bitwise_not(x["down"]).alias("score"), x["id"].alias("id"))).alias("positives"))
    asking = stored(anchors.join(best, key).where(F.size("positives") > 0), "op12-positives")

    # What the anchors of a cell can want at all, and the cells that may hold it.
    lowest, highest = np.full(cells, math.inf), np.full(cells, -math.inf)
    per_cell = asking.select("cell", F.explode("positives.score").alias("p")).where("p >= 0").groupBy("cell").agg(F.min("p").alias("l"), F.max("p").alias("h"))
    for r in per_cell.collect():  # at most ``cells`` rows
        lowest[r["cell"]], highest[r["cell"]] = r["l"] * low / 100 * (1 - 1e-9) - 1, r["h"] * high / 100 * (1 + 1e-9) + 1
    ball = lambda c, r: Node(0, 0, centres[c], r[c], 0, 0)
    allowed = np.zeros_like(present)
    for a, c in zip(*np.nonzero(present), strict=True):
        least, most = interval(ball(a, anchor_radius), ball(c, radius))
        allowed[a, c] = most >= lowest[a] and least <= highest[a]
    columns = "vec_id long, label long, vh long, positive_score long, entry struct<down:long,id:long>"
    offered = _tiles(asking, placed, allowed, groups, blocks, lambda a, b: _negatives(a, b, negatives, low, high), columns)
    rank = F.row_number().over(Window.partitionBy(*key, "positive_score").orderBy("entry"))
    found = offered.withColumn("rank", rank).where(F.col("rank") <= negatives)
    pairs = asking.select(*key, "times", F.explode("positives").alias("p")).select(*key, "times", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = pairs.join(found, [*key, "positive_score"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("entry.id").alias("negative_id"), "positive_score",
        F.bitwise_not("entry.down").alias("negative_score"),
    )


def hard_negatives(rows: DataFrame) -> DataFrame:
    """The contract's result for a table (vec_id, embedding, label)."""
    return mine(take_part(rows))
