"""Repairs the structure of conversations at the least cost.

A conversation's edits are a way through a lattice: a node is the number of rows behind
and what the roles so far allow next; keeping, changing, deleting and inserting are arcs
with integer costs.  Shortest ways are found by an auction: every node has a price, at
most the cost of the rest of the way; the path from an origin is extended along its
cheapest arc if the price equals what that arc asks, else the price is raised to that and
the path contracted.  Origins are taken from the end of the conversation to its start, and
a path is done where it meets a node of an earlier one, so that each is dealt with in a few
steps however long the conversation.  Prices have then converged to the exact costs; the
arcs on which they are tight are those of all cheapest ways, and of these the first by
letters is traced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 1, 2, 5, 5  # costs; the last one is added for a truncated row
LOTS = 20

# What may come next: the start, after a system turn, after a user turn, after an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # where a user or assistant turn leads, whichever fits
_KEPT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_SPACES = " \t\n\x0b\x0c\r"
_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_SLICE = 4 << 20

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_AUDITS = "conv_id bigint, " + ", ".join(f"{name} bigint" for name in _COUNTS) + ", audit string"


def damage(turns: DataFrame) -> DataFrame:
    """``turns (conv_id, turn, role, text)`` damaged by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats
    it, 4 makes its role user.  Nulls are one space, in the crc32 as well; a null turn stays
    null for the order.  ``gone`` marks the dropped rows, which are returned for the sake
    of conversations of which nothing is left.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    lot = F.pmod(F.crc32(key.cast("binary")), F.lit(LOTS))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (lot == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(lot == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _coded(turns: DataFrame) -> DataFrame:
    """Rows with a hash of role and text, which orders rows of one turn and tells duplicates."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.sha2(content.cast("binary"), 256).alias("code"),
        role.alias("role"),
        text.alias("text"),
        gone.alias("gone"),
    )


def audits(turns: DataFrame) -> DataFrame:
    """Faults and cheapest edits of every conversation of ``turns (conv_id, turn, role, text)``.

    Rows are in order of ``turn``, null first, then of a hash of role and text.  A row's
    first fault counts: blank, duplicate (role and text seen earlier), truncated (its last
    character but white space is none of ``.!?``).  ``gaps`` counts the numbers missing
    between the smallest and the largest turn, ``illegal`` the neighbours whose roles do
    not follow each other.  ``audit`` has the initials of the edits in order: K keeps, R
    changes the role, D deletes, I inserts an empty turn.  Rows with ``gone`` only name
    their conversation; one without other rows has zeros and an empty audit.  A null id
    is a conversation like others, a null role or text one space.

    Texts are not shuffled: a conversation passes through one task with some 100 bytes a row.
    """
    rows = _coded(turns)
    bare = F.rtrim("text", F.lit(_SPACES))
    fault = F.when(bare == "", _BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), _TRUNCATED).otherwise(_FINE)
    rows = rows.select("conv_id", "turn", "code", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), "gone")
    order = ["conv_id", F.asc_nulls_first("turn"), "code"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_audit_all, _AUDITS)


def repair_report(turns: DataFrame) -> DataFrame:
    """:func:`audits` with ``repaired_sha256``, the hash of the repaired conversation.

    Hashed are ``role:text`` of all turns, joined by newlines.  Texts stream through the
    task of their conversation, and none is kept.
    """
    return _with_rows(turns).mapInArrow(_report, f"{_AUDITS}, repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, role, text``, positions from 0."""
    return _with_rows(turns).mapInArrow(_texts, "conv_id bigint, position bigint, role string, text string")


def _with_rows(turns: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    rows = _coded(turns).filter("not gone").drop("gone").withColumn("is_row", F.lit(1))
    found = audits(turns).withColumn("is_row", F.lit(0))
    both = found.unionByName(rows, allowMissingColumns=True)
    order = ["conv_id", "is_row", F.asc_nulls_first("turn"), "code"]
    names = ["conv_id", "is_row", "audit", "role", "text", *_COUNTS]
    return both.repartition("conv_id").sortWithinPartitions(*order).select(*names)


def _audit_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    rows: list[tuple] = []
    started, last = False, None
    for batch in batches:
        for conv_id, *row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if started and conv_id != last:
                held.append([last, *_audit(rows)])
                rows = []
            started, last = True, conv_id
            rows.append(tuple(row))
        yield _batch(held, _AUDITS)
        held = []
    if started:
        yield _batch([[last, *_audit(rows)]], _AUDITS)


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(column.split() for column in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    types = [pa.int64() if kind == "bigint" else pa.string() for kind in kinds]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], list(names))


def _audit(rows: list[tuple]) -> list:
    """Counts and edits of one conversation's ``(turn, code, initial, fault, gone)``."""
    rows = [row[:4] for row in rows if not row[4]]
    numbers = [turn for turn, *_ in rows if turn is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen: set[bytes] = set()
    faults = []
    for _, code, _, fault in rows:
        code = bytes.fromhex(code)
        if fault != _BLANK and code in seen:
            fault = _DUPLICATE
        seen.add(code)
        faults.append(fault)
    initials = [row[2] for row in rows]
    illegal = sum(pair not in _LEGAL for pair in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest_edits(initials, faults)
    return [gaps, *(faults.count(x) for x in (_BLANK, _DUPLICATE, _TRUNCATED)), illegal, cost, audit]


def _arcs(node: int, initials: list[str], faults: list[int]) -> list[tuple[str, int, int]]:
    """Arcs out of a node ``4 * rows behind + state`` in order of their letters: letter, cost, node.

    An arc to -1 ends the conversation.
    """
    i, state = divmod(node, 4)
    insert = ("I", INSERT, node - state + _NEXT[state])
    if i == len(faults):
        return [("", 0, -1), insert] if state in (_START, _ASSISTANT) else [insert]
    found = [("D", DELETE, node + 4), insert]
    if faults[i] in (_FINE, _TRUNCATED):
        more = UNENDED if faults[i] == _TRUNCATED else 0
        follows = _KEPT[state].get(initials[i])
        if follows is not None:
            found.append(("K", KEEP + more, node - state + 4 + follows))
        found.append(("R", REROLE + more, node - state + 4 + _NEXT[state]))
    return found


def cheapest_edits(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, of several the first by letters."""
    n = len(faults)
    # A row costs at least what it costs without its neighbours: prices that no arc undercuts.
    price = [0] * (4 * n + 5)  # the last one, which -1 finds, is the end's
    for i in range(n - 1, -1, -1):
        least = price[4 * i + 4] + (KEEP if faults[i] == _FINE else DELETE)
        price[4 * i : 4 * i + 4] = [least] * 4
    exact = [False] * (4 * n + 4) + [True]
    for origin in range(4 * n + 3, -1, -1):
        path = [origin]
        while not exact[path[-1]]:
            node = path[-1]
            asked, to = min((cost + price[to], to) for _, cost, to in _arcs(node, initials, faults))
            if price[node] < asked:
                price[node] = asked
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            exact[node] = True
    letters, node = [], _START
    while node != -1:
        for letter, cost, to in _arcs(node, initials, faults):
            if price[node] == cost + price[to]:
                letters.append(letter)
                node = to
                break
    return price[_START], "".join(letters)


class _Editor:
    """Applies an audit to the rows as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.n, self.system = audit, 0, 0, 0

    def _fitting(self) -> str:
        return "assistant" if (self.n - self.system) % 2 else "user"

    def _turn(self, role: str, text: str) -> tuple[int, str, str]:
        self.n += 1
        return self.n - 1, role, text

    def inserts(self) -> Iterator[tuple[int, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._turn(self._fitting(), "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            if self.n == 0 and role[:1] == "s":
                self.system = 1
            yield self._turn(role, text)
        elif letter == "R":
            yield self._turn(self._fitting(), text)


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list | None, Iterable[tuple[int, str, str]]]]:
    """A header and the inserts at the end of the conversation before, or no header and a row's turns."""
    editor = None
    for batch in bounded_batches(batches, _SLICE):
        for conv_id, is_row, audit, role, text, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if is_row:
                yield None, editor.row(role, text)
            else:
                yield [conv_id, *counts, audit], editor.inserts() if editor else ()
                editor = _Editor(audit)
    if editor:
        yield [], editor.inserts()


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = f"{_AUDITS}, repaired_sha256 string"
    head, hashed, held = None, None, []
    for header, turns in _edited(batches):
        for position, role, text in turns:
            hashed.update(f"{chr(10) if position else ''}{role}:{text}".encode())
        if header is not None:
            if head:
                held.append([*head, hashed.hexdigest()])
            head, hashed = header, hashlib.sha256()
            if len(held) >= 1000:
                yield _batch(held, schema)
                held = []
    yield _batch(held, schema)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = "conv_id bigint, position bigint, role string, text string"
    conv_id, held, size = None, [], 0
    for header, turns in _edited(batches):
        for turn in turns:
            held.append([conv_id, *turn])
            size += len(turn[2]) + 100
        if header:
            conv_id = header[0]
        if size >= _SLICE:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)
