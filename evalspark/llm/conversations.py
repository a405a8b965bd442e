"""Conversation structure repair: the cheapest edits that give each conversation the roles of `(s?(ua)+)?`.

Rows are dealt out by conversation and sorted by turn; a task reads them as a stream and carries, across Arrow batches, the state of a dynamic
program: for each role that a repaired conversation can end with so far the least cost, the rank of its edits in ASCII order, and the hash of the
text so far. What the edits were is told by back pointers of 20 bits a row, kept in memory up to SPILL rows of a conversation and
in a temporary file of the task, gone with it, beyond. So a conversation of any length takes bounded memory but for its audit.

That a row repeats an earlier one is told before, by a window over the rows of a conversation that have one role and text: a conversation's rows are spread over tasks there.

Why ranks are enough: inserts stand right before the row they make room for (an insert before a deletion is worse in ASCII order than one after it), so of two
different edits up to one row neither is a beginning of the other, and what follows can't change their order.

NULL roles and texts are one space; a NULL conv_id is a conversation of its own; rows of NULL turn come first; rows of one turn go by role and text, so
those that repeat a row are beside it. Empty tables give no rows, extra columns are ignored.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import arrow_rows, written

#: White space of the contract, as the characters to trim.
SPACE = " \t\n\x0b\f\r"
#: Back pointers of a conversation in memory; rows that Python gets at once.
SPILL, TEXT_ROWS = 1 << 18, 1000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults of a row.
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Ends of a repaired beginning: nothing, system, user, assistant. What an insert leads to, and the inserts that complete each.
START, SYSTEM, USER, ASSISTANT = range(4)
_INSERTED = (USER, USER, ASSISTANT, USER)
_CLOSING = ("", "II", "I", "")
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Edits of a row with the insert before it, in ASCII order.
EDITS = ("D", "IK", "IR", "K", "R")
_PLACE = {x: k for k, x in enumerate(EDITS)}


def kept_end(end: int, initial: str) -> int | None:
    """What a beginning that ends so ends with after a row of this initial is kept, None where it can't be."""
    if initial == "s":
        return SYSTEM if end == START else None
    if initial == "u":
        return USER if end != USER else None
    return ASSISTANT if initial == "a" and end == USER else None


@lru_cache(maxsize=None)
def moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, edit) for a row."""
    found = [(end, end, DELETE, _PLACE["D"]) for end in range(4)]
    if fault in (BLANK, DUPLICATE):
        return found
    more = TRUNCATED if fault == CUT else 0
    for end in range(4):
        for name, at, cost in (("", end, more), ("I", _INSERTED[end], more + INSERT)):
            if (to := kept_end(at, initial)) is not None:
                found.append((end, to, cost + KEEP, _PLACE[f"{name}K"]))
            found.append((end, _INSERTED[at], cost + REROLE, _PLACE[f"{name}R"]))
    return found


def edited(end: int, edit: str, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """The end, and the rows (role, text), that an edit of EDITS gives after a beginning that ends so."""
    rows = []
    if edit == "D":
        return end, rows
    if edit[0] == "I":
        end = _INSERTED[end]
        rows.append((_ROLES[end], ""))
    to = kept_end(end, role[:1]) if edit[-1] == "K" else _INSERTED[end]
    rows.append((role if edit[-1] == "K" else _ROLES[to], text))
    return to, rows


class Pointers:
    """Numbers of 32 bits that are put one by one and read from the last to the first; beyond SPILL in a temporary file."""

    def __init__(self, most: int = SPILL) -> None:
        self.most, self.now, self.file = most, array("I"), None

    def put(self, value: int) -> None:
        self.now.append(value)
        if len(self.now) >= self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.now.tofile(self.file)
            self.now = array("I")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.now)
        if self.file:
            for block in range(self.file.tell() // (4 * self.most) - 1, -1, -1):
                self.file.seek(4 * self.most * block)
                part = array("I")
                part.fromfile(self.file, self.most)
                yield from reversed(part)
            self.file.close()


class Repair:
    """The report of one conversation, from its rows in order."""

    def __init__(self, conv_id: object, spill: int = SPILL) -> None:
        self.conv_id, self.faults, self.illegal, self.before = conv_id, [0, 0, 0, 0], 0, None
        self.least = self.last = None
        self.turns = 0
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self.text = [sha256(), None, None, None]
        self.pointers = Pointers(spill)

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        steps = moves(initial if initial in "sua" else "", fault)
        found: list[tuple[int, int, int, int] | None] = [None] * 4
        for start, to, cost, edit in steps:
            if (now := self.best[start]) is not None:
                option = (now[0] + cost, now[1], edit, start)
                if found[to] is None or option < found[to]:
                    found[to] = option
        order = sorted(x[1:3] for x in found if x)
        self.best = [x and (x[0], order.index(x[1:3])) for x in found]
        self.text = [x and self._told(x[3], EDITS[x[2]], role, text) for x in found]
        self.pointers.put(sum((x[2] << 2 | x[3]) << 5 * k for k, x in enumerate(found) if x))

    def _told(self, start: int, edit: str, role: str, text: str):
        told = self.text[start].copy()
        for k, (name, words) in enumerate(edited(start, edit, role, text)[1]):
            told.update((("" if start == START and k == 0 else "\n") + f"{name}:{words}").encode("utf-8", "surrogatepass"))
        return told

    def report(self) -> tuple:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        cost, _, _, end = min((x[0] + INSERT * len(_CLOSING[k]), x[1], _CLOSING[k], k) for k, x in enumerate(self.best) if x)
        told, at = self.text[end], end
        for _ in _CLOSING[end]:
            at = _INSERTED[at]
            told.update(f"\n{_ROLES[at]}:".encode())
        audit = bytearray(_CLOSING[end].encode())
        for value in self.pointers.backwards():
            x = value >> 5 * end
            audit += EDITS[x >> 2 & 7][::-1].encode()
            end = x & 3
        audit.reverse()
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, audit.decode(), told.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped, 2: repeated) of conversations, damaged by the hash of conv_id and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def faulty(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with the fault of the first copy of each; others but blank ones are duplicates."""
    words: Column = F.rtrim("text", F.lit(SPACE))
    same = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    line = Window.partitionBy("conv_id", "_same").orderBy(F.col("copies") == 0, F.col("turn").asc_nulls_first())
    placed = rows.withColumn("_same", same).withColumn("_again", F.row_number().over(line) > 1)
    fault = F.when(words == "", BLANK).when(F.col("_again"), DUPLICATE).when(~F.substring(words, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE)
    return placed.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def repair(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """The report of each conversation of rows (conv_id, turn, role, text, and copies, 1 where a row counts once): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), types)], names=names)

        for batch in batches:
            for conv, turn, role, text, copies, fault in zip(*(x.to_pylist() for x in batch.columns)):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out.append(now.report())
                        if len(out) >= TEXT_ROWS:
                            yield full()
                            out = []
                    now = Repair(conv, spill)
                for k in range(copies):
                    now.row(turn, role, text, DUPLICATE if k and fault != BLANK else fault)
        if now is not None:
            out.append(now.report())
            yield full()

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    placed = in_order(faulty(_typed(rows)))
    with arrow_rows(rows.sparkSession, TEXT_ROWS):
        return written(placed.mapInArrow(run, ", ".join(f"{x} {'string' if k > 6 else 'long'}" for k, x in enumerate(names))), "repair")


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies")


def in_order(marked: DataFrame, *first: Column) -> DataFrame:
    """A conversation's rows in one task, by turn, role and text. Of rows that are alike all but one are duplicates: the other one comes before them."""
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE)


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text: the conversations of rows (conv_id, turn, role, text, copies) after the edits that their reports tell; one of which nothing is left has no rows.

    A conversation's audit comes before its rows in the stream, and each row is edited as it passes.
    """
    audits = report.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(-1).alias("copies"), F.lit(0).alias("fault"))
    both = in_order(faulty(_typed(rows)).unionByName(audits), F.col("copies") >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, end, place, out = None, "", 0, START, 0, []

        def put(made: list[tuple[str, str]]) -> None:
            nonlocal place
            for role, text in made:
                place += 1
                out.append((conv, place, role, text))

        def inserted() -> None:
            nonlocal at, end
            while at < len(audit) and audit[at] == "I":
                at, end = at + 1, _INSERTED[end]
                put([(_ROLES[end], "")])

        for batch in batches:
            for this, _, role, text, copies, _ in zip(*(x.to_pylist() for x in batch.columns)):
                if copies < 0:
                    inserted()
                    conv, audit, at, end, place = this, text, 0, START, 0
                for _ in range(max(copies, 0)):
                    inserted()
                    end, made = edited(end, audit[at], role, text)
                    at += 1
                    put(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)
                out.clear()
        inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)

    names, kinds = ["conv_id", "place", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return both.mapInArrow(run, "conv_id long, place long, role string, text string")
