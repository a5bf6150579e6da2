"""Operator 13, conversation structure repair: error-correcting Earley parsing of roles.

The grammar of a conversation is ``(s?(ua)+)?`` over the first letters of its roles, written left-recursively::

    Dialog  -> (nothing) | Turns
    Turns   -> Opening u a | Turns u a
    Opening -> (nothing) | s

Errors are productions with weights: a row is deleted (D), an item staying as it is while the row is read; ``u`` and ``a`` may derive a row of another
role (R) or no row at all (I). Chart items are (production, dot), all from the chart's first set, since the grammar is
left-recursive; each retains its minimum (cost, audit), so a set holds a dozen items at most and a conversation is read once, row by row.
Equal costs are settled by the audit, character by character. Two audits of one item, set and cost are never each other's beginnings, because what
is longer has an insertion more and costs more; so the smaller beginning gives the smaller whole, and keeping only the minimum loses
nothing. The completed chart (Dialog, complete, after the last row) yields the repair.

An item carries the running SHA-256 of its repaired rows, so no text is kept. What all live audits share is put aside; an item that costs more than the cheapest item between turns and two
insertions can never win and goes. Memory therefore does not grow with the rows of a conversation but for its
audit, a character a row, which is the result.

Rows are dealt by conversation, sorted by Spark (which spills), and streamed: a conversation of any length is read in order by one task,
as its hash of all rows in order asks, and is never gathered. Rows that repeat an earlier one are found before that, from counts of
(conversation, hash of role and text), joined back with whatever strategy AQE finds, skewed keys split.

Defined results: null roles and texts are one space; a null ``conv_id`` is one conversation of its own and a null ``turn`` comes first, both
written as one space where damage is drawn; rows of one turn are ordered by role and text; a role that does not begin with s, u or a can
only be deleted or get another role; a conversation without rows left has zeros, an empty audit and the hash of the empty text; an
empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE_CLASS

#: Weights of the error productions; a truncated row that stays costs TRUNCATED more.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}

#: Productions as (head, body) and the chart items (production, dot).
GRAMMAR = (
    ("Dialog", ()), ("Dialog", ("Turns",)),
    ("Turns", ("Opening", "u", "a")), ("Turns", ("Turns", "u", "a")),
    ("Opening", ()), ("Opening", ("s",)),
)
START = "Dialog"
#: Rows after which the common beginning of all audits is put aside.
COMMIT = 64

Item = tuple[int, int]


class Derivation:
    """Cost, audit since the last commit, and the running hash of what the repaired conversation says so far."""

    __slots__ = ("audit", "cost", "digest", "spoken")

    def __init__(self, cost: int = 0, audit: str = "", digest=None, spoken: bool = False):
        self.cost, self.audit, self.digest, self.spoken = cost, audit, digest or hashlib.sha256(), spoken

    def step(self, cost: int, letter: str, said: bytes | None) -> Derivation:
        """One more edit; ``said`` is the row that it puts into the conversation."""
        if said is None:
            return Derivation(self.cost + cost, self.audit + letter, self.digest, self.spoken)
        digest = self.digest.copy()
        digest.update(b"\n" + said if self.spoken else said)
        return Derivation(self.cost + cost, self.audit + letter, digest, True)

    def beats(self, cost: int, audit: str) -> bool:
        return (self.cost, self.audit) <= (cost, audit)


class Chart:
    """The current Earley set of one conversation; earlier sets are not needed but for the first one's waiting items."""

    def __init__(self):
        self.items: dict[Item, Derivation] = {}
        self.committed: list[str] = []
        self.rows = 0
        work = [((p, 0), Derivation()) for p, (head, _) in enumerate(GRAMMAR) if head == START]
        predicted = {START}
        for (p, _), _d in work:  # grows while it is read: the predictor
            body = GRAMMAR[p][1]
            if body and body[0] not in predicted and body[0].istitle():
                predicted.add(body[0])
                work += [((q, 0), Derivation()) for q, (head, _) in enumerate(GRAMMAR) if head == body[0]]
        #: Items of the first set that wait for a nonterminal, by its name.
        self.waiting: dict[str, list[int]] = {}
        for (p, _), _d in work:
            body = GRAMMAR[p][1]
            if body and body[0].istitle():
                self.waiting.setdefault(body[0], []).append(p)
        self._close(work)

    def _close(self, work: list[tuple[Item, Derivation]]) -> None:
        """Complete, and insert rows that are missing, until no item gets better."""
        items: dict[Item, Derivation] = {}
        work = list(work)
        while work:
            item, new = work.pop()
            old = items.get(item)
            if old is not None and old.beats(new.cost, new.audit):
                continue
            items[item] = new
            production, dot = item
            head, body = GRAMMAR[production]
            if dot == len(body):
                work += [((p, 1), new) for p in self.waiting.get(head, ())]
            elif body[dot] in ROLES:
                work.append(((production, dot + 1), new.step(INSERT, "I", f"{ROLES[body[dot]]}:".encode())))
        between = min((d.cost for (p, dot), d in items.items() if GRAMMAR[p][0] == "Turns" and dot == len(GRAMMAR[p][1])), default=None)
        self.items = items if between is None else {i: d for i, d in items.items() if d.cost <= between + 2 * INSERT}

    def scan(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """Read one row: every item deletes it or, unless it must go, derives it from the symbol behind its dot."""
        work = []
        for item, d in self.items.items():
            production, dot = item
            body = GRAMMAR[production][1]
            if dot < len(body) and body[dot].istitle():
                continue  # waits in the first set only
            if dot < len(body) or GRAMMAR[production][0] == START:
                work.append((item, d.step(DELETE, "D", None)))
            if dot == len(body) or must_go:
                continue
            extra, symbol = TRUNCATED * truncated, body[dot]
            if role[:1] == symbol:
                work.append(((production, dot + 1), d.step(extra, "K", f"{role}:{text}".encode("utf-8", "surrogatepass"))))
            if symbol in ROLES and role != ROLES[symbol]:
                work.append(((production, dot + 1), d.step(REROLE + extra, "R", f"{ROLES[symbol]}:{text}".encode("utf-8", "surrogatepass"))))
        self._close(work)
        self.rows += 1
        if self.rows % COMMIT == 0:
            shared = os.path.commonprefix([d.audit for d in self.items.values()])
            if shared:
                self.committed.append(shared)
                for d in {id(d): d for d in self.items.values()}.values():
                    d.audit = d.audit[len(shared) :]

    def repair(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256) of the cheapest complete parse."""
        best = min((d for (p, dot), d in self.items.items() if GRAMMAR[p][0] == START and dot == len(GRAMMAR[p][1])), key=lambda d: (d.cost, d.audit))
        return best.cost, "".join(self.committed) + best.audit, best.digest.hexdigest()


LEGAL = {"su", "ua", "au"}
RESULT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Conversation:
    """What is counted and repaired of one conversation while its rows pass in order."""

    def __init__(self, conv_id):
        self.conv_id, self.chart = conv_id, Chart()
        self.first = self.last = self.initial = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def row(self, turn, role: str, text: str, copies: int, blank: bool, repeats: bool, truncated: bool) -> None:
        """``repeats``: an earlier turn has the same role and text. Rows of one turn with the same role and text are neighbours."""
        for _ in range(copies):
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            again = repeats or self.before == (turn, role, text)
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            if fault:
                setattr(self, fault, getattr(self, fault) + 1)
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in LEGAL
            self.initial, self.before = role[:1], (turn, role, text)
            self.chart.scan(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.chart.repair())


def _streamed(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for conv_id, turn, role, text, *facts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv_id)
            now.row(turn, role, text, *facts)
            if len(done) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
    if now is not None:
        done.append(now.result())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by rule, with ``copies``: 0 where a row is dropped, 2 where it is repeated."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), drawn.alias("d"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("copies"),
    )


def _said() -> Column:
    """A key of role and text."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``rows`` (conv_id, turn, role, text, copies): faults by kind, and the cheapest repair."""
    rows = rows.select("conv_id", "turn", "role", "text", "copies", _said().alias("said"))
    at = F.struct(F.col("turn").isNotNull(), "turn")
    twice = rows.where("copies > 0").groupBy("conv_id", "said").agg(F.count("*").alias("n"), F.min(at).alias("earliest")).where("n > 1")
    twice = twice.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "earliest")
    met = rows.join(twice, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    facts = met.select(
        "conv_id", "turn", "role", "text", "copies",
        (~F.col("text").rlike(f"[^{SPACE_CLASS}]")).alias("blank"),
        F.coalesce(at > F.col("earliest"), F.lit(False)).alias("repeats"),
        (~F.col("text").rlike(rf"[.!?][{SPACE_CLASS}]*\z")).alias("truncated"),
    )
    ordered = facts.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType
    result = RESULT.format(kind.simpleString())
    names = pa.schema([("conv_id", pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string())])
    for field in result.split(", ")[1:]:
        name, of = field.split(" ")
        names = names.append(pa.field(name, pa.int64() if of == "long" else pa.string()))
    return ordered.mapInArrow(lambda batches: _streamed(batches, names), result)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
