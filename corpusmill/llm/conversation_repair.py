"""Conversation structure repair: the cheapest edits that give a conversation the roles `(system? (user assistant)+)?`.

Turns are grouped and sorted by Spark; one forward Viterbi pass a conversation reads them in order. Its four states are
what the repaired turns end with so far: nothing, system, user or assistant. Each state carries its minimum (cost, audit),
audit being the initials of the edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit of blank turns and of
duplicates), Insert an empty user or assistant turn 2; a truncated turn that stays costs 1. After every turn inserts are followed
until no state improves, three steps at most. Of equal costs the audit that is least in ASCII wins; equal
costs after the same turn never have audits of which one begins the other, so comparing them turn by turn is exact.

A turn's first fault counts: blank (no character but white space \\x20 and \\x09-\\x0D), duplicate (role and text of an earlier turn),
truncated (last such character none of `.!?`).

The pass is a stream: what all states agree on is settled every SETTLE turns, and settled turns leave memory. A conversation is read by one
task, as its digest is one running hash; a task holds the open turns, one conversation's audit and no group of texts. What leaves turns open
is a choice that later turns have to make, as whether a first turn goes so that a system turn may open; deleted turns are held without text.

Defined results: null roles and texts count as one space, null turns come first, turns with equal numbers go by role, then text; equal
rows are duplicates; an empty role has no initial and cannot be kept; a null conv_id is a conversation; an empty table gives an
empty table; columns beyond the four are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.textbatch import tidy

WHITE = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: (initial of a turn's role, state before) -> state after; whatever is not here is no legal turn.
LEGAL = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
#: The role that an inserted or changed turn takes in a state, and the state after it.
NEXT = {NONE: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ADJACENT = {"su", "ua", "au"}
#: Turns after which what all states agree on is settled.
SETTLE = 128

Best = dict[int, tuple[int, str]]


def _offer(best: Best, state: int, cost: int, audit: str) -> bool:
    if state in best and best[state] <= (cost, audit):
        return False
    best[state] = (cost, audit)
    return True


def _close(best: Best) -> Best:
    """Follow inserts. Three steps lead from any state to all that it can reach; more would come back dearer."""
    for _ in range(3):
        if not any([_offer(best, NEXT[s][1], cost + INSERT, audit + "I") for s, (cost, audit) in list(best.items())]):
            break
    # States that can no longer win: an assistant turn goes on as a system turn does, and as no turn does but for one deleted system turn.
    if best.get(SYSTEM, best[ASSISTANT])[0] > best[ASSISTANT][0]:
        del best[SYSTEM]
    if best.get(NONE, best[ASSISTANT])[0] > best[ASSISTANT][0] + DELETE:
        del best[NONE]
    return best


def _turn(best: Best, initial: str, deleted: bool, truncated: bool) -> Best:
    """The states after one more turn."""
    out: Best = {}
    extra = TRUNCATED if truncated else 0
    for state, (cost, audit) in best.items():
        _offer(out, state, cost + DELETE, audit + "D")
        if not deleted:
            if (initial, state) in LEGAL:
                _offer(out, LEGAL[initial, state], cost + KEEP + extra, audit + "K")
            _offer(out, NEXT[state][1], cost + REROLE + extra, audit + "R")
    return _close(out)


class Conversation:
    """Takes a conversation's turns in order; `emit` gets the repaired ones as (role, text, edit) once they are settled."""

    def __init__(self, emit: Callable[[str, str, str], None]) -> None:
        self.emit, self.best = emit, _close({NONE: (0, "")})
        self.open: list[tuple[str, str] | None] = []  # turns whose edit is not settled; deleted ones without text
        self.next = 0  # the first open turn
        self.state, self.settled = NONE, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = None
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """`seen`: an earlier turn had this role and text."""
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first, self.last = (turn if self.first is None else self.first), turn
        initial, bare = role[:1], text.rstrip(WHITE)
        if self.before is not None and self.before + initial not in ADJACENT:
            self.illegal += 1
        self.before = initial
        blank = not bare
        duplicate = seen and not blank
        truncated = not (blank or duplicate) and bare[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        gone = blank or duplicate
        self.best = _turn(self.best, initial, gone, truncated)
        self.open.append(None if gone else (role, text))
        if len(self.open) - self.next >= SETTLE:
            self._settle(os.path.commonprefix([audit for _, audit in self.best.values()]))

    def _settle(self, audit: str) -> None:
        if not audit:
            return
        self.settled.append(audit)
        self.best = {s: (cost, a[len(audit) :]) for s, (cost, a) in self.best.items()}
        for edit in audit:
            role, text = "", ""
            if edit != "I":
                own = self.open[self.next]
                self.next += 1
                if edit == "D":
                    continue
                role, text = own
            if edit == "K":
                self.state = LEGAL[role[:1], self.state]
            else:
                role, self.state = NEXT[self.state]
            self.emit(role, text, edit)
        del self.open[: self.next]
        self.next = 0

    def finish(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost and audit of the whole conversation."""
        cost, audit = min(self.best[s] for s in (NONE, ASSISTANT) if s in self.best)
        self._settle(audit)
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_IN_ORDER = ("conv_id", "turn", "role", "text", "seen")


def _in_order(turns: DataFrame) -> DataFrame:
    """The turns, a conversation in one partition and in order. One shuffle: the window finds its rows there already."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), one_space("role"), one_space("text")).repartition("conv_id")
    by_turn = F.col("turn").asc_nulls_first()
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(by_turn)) > 1
    return rows.withColumn("seen", seen).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), by_turn, "role", "text", "seen").select(*_IN_ORDER)


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable[[object], Callable[[str, str, str], None]]) -> Iterator[tuple[object, Conversation] | None]:
    """Each conversation with its id once all its turns are read; None after every batch. `begin` gives the taker of an id's repaired turns."""
    at: Conversation | None = None
    name: object = None
    for batch in batches:
        for conv, *turn in zip(*(batch.column(c).to_pylist() for c in _IN_ORDER), strict=True):
            if at is None or conv != name:
                if at is not None:
                    yield name, at
                name, at = conv, Conversation(begin(conv))
            at.add(*turn)
        yield None
    if at is not None:
        yield name, at


def report(turns: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cost and audit of the cheapest repair, and the SHA-256 of the repaired `role:text` joined by line feeds."""
    id_type = turns.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        lines = 0

        def begin(conv: object) -> Callable[[str, str, str], None]:
            nonlocal digest, lines
            digest, lines = hashlib.sha256(), 0
            return take

        def take(role: str, text: str, edit: str) -> None:
            nonlocal lines
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1

        rows: list[tuple] = []
        for got in _conversations(batches, begin):
            if got:
                rows.append((got[0], *got[1].finish(), digest.hexdigest()))
            if rows and (not got or len(rows) >= 1000):
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    schema = T.StructType([T.StructField("conv_id", id_type), *[T.StructField(c, T.StringType() if c in ("audit", "repaired_sha256") else T.LongType()) for c in REPORT]])
    return _in_order(turns).mapInArrow(tidy(run), schema)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text and edit (K, R or I)."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("place", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def begin(conv: object) -> Callable[[str, str, str], None]:
            place = iter(range(1 << 62))
            return lambda role, text, edit: rows.append((conv, next(place), role, text, edit))

        for got in _conversations(batches, begin):
            if got:
                got[1].finish()
            if rows and (not got or len(rows) >= 1000):
                yield _batch(rows, schema)
                rows.clear()
        if rows:
            yield _batch(rows, schema)

    return _in_order(turns).mapInArrow(tidy(run), schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def damage(turns: DataFrame) -> DataFrame:
    """Turns with seeded faults by the CRC-32 of `conv_id:turn` modulo 20: 0 drops the turn, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes it a user's."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat_ws(":", one_space("conv_id"), one_space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")
