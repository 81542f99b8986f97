"""Repair of the turn structure of conversations, at the least cost of edits.

A conversation is in order if its roles' initials read `(s?(ua)+)?`. Every row may be
kept (cost 0), given the role of user or assistant (2) or deleted (3), and rows without
text of user or assistant may be inserted anywhere (2 each). Blank rows and rows whose
role and text came before must go; a truncated row that stays costs 1 more. Of the
cheapest edits those count whose letters, D I K R in order, read least in ASCII.

A row is one of few symbols: its role, whether it must go, whether it is truncated. The
step over a symbol is a 4 x 4 matrix of costs between the states of the order, and steps
combine by the min-plus product. Equal symbols that follow each other are one run, which
is advanced through binary powers of its matrix; these are kept for all conversations of
a task. The costs to the end are known at the ends of runs only; a run's own letters are
unrolled by halves, so that no more than its logarithm of cost vectors is held at once.

How it runs: equal rows are counted first, on the map side too, so that copies travel as
one row, and the first turn of each role and text is a minimum, not a window. A task sees
a conversation's rows in order without their texts, and holds their runs and one letter a
row. The texts are dealt and sorted once more behind those letters and pass through
one by one, so a conversation's length counts in letters, not in text.

Defined results: a NULL role or text is one space. Rows are ordered by turn, NULL first,
then by role and by the SHA-256 of the text; equal rows are counted as copies. A role
counts by its first character; an empty role by a space, and is never in order. Rows without conversation
id form one conversation. A conversation without rows has no faults, no edits and no
repaired rows. No conversations give no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.llm.store import kept

NOT_SPACE = r"[^\x20\x09-\x0D]"

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
"""Costs; keeping is free."""

# States of the order: nothing yet, behind the system's turn, the user's, the assistant's.
STATES = 4
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FILL = ("u", "u", "a", "u")
"""The role of user or assistant that may come in each state."""
_ACCEPTS = (True, False, False, True)
_NAMES = {"u": "user", "a": "assistant"}
_FAR = 1 << 60


def _after(state: int, role: str) -> int:
    return _AFTER.get((state, role), -1)


def end_costs() -> tuple[int, ...]:
    """The cheapest insertions that end a conversation, from each state."""
    costs = [0 if fine else _FAR for fine in _ACCEPTS]
    for _ in range(STATES):
        costs = [min(c, INSERT + costs[_after(q, _FILL[q])]) for q, c in enumerate(costs)]
    return tuple(costs)


def step_costs(symbol: str) -> tuple[tuple[int, ...], ...]:
    """The cost from state to state over one row, insertions before it included.

    A symbol is the role's initial (`s`, `u`, `a`, or `-`) and `x` if the row must go, `t`
    if it is truncated, `.` otherwise.
    """
    role, fault = symbol
    edits = [[_FAR] * STATES for _ in range(STATES)]
    for q in range(STATES):
        edits[q][q] = DELETE
        if fault != "x":
            more = TRUNCATED if fault == "t" else 0
            for to, cost in ((_after(q, role), more), (_after(q, _FILL[q]), REROLE + more)):
                if to >= 0:
                    edits[q][to] = min(edits[q][to], cost)
    for _ in range(STATES):
        edits = [[min(cost, INSERT + edits[_after(q, _FILL[q])][to]) for to, cost in enumerate(row)] for q, row in enumerate(edits)]
    return tuple(map(tuple, edits))


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[q][k] + b[k][to] for k in range(STATES)) for to in range(STATES)) for q in range(STATES))


class Powers(dict):
    """The matrices of 2^k equal rows, by symbol; made once and doubled as runs ask for more."""

    def __missing__(self, symbol: str) -> list[tuple]:
        self[symbol] = [step_costs(symbol)]
        return self[symbol]

    def over(self, symbol: str, k: int) -> tuple:
        held = self[symbol]
        while len(held) <= k:
            held.append(_product(held[-1], held[-1]))
        return held[k]

    def before(self, symbol: str, rows: int, costs: tuple[int, ...]) -> tuple[int, ...]:
        """Costs to the end before a run, from those behind it."""
        k = 0
        while rows:
            if rows & 1:
                matrix = self.over(symbol, k)
                costs = tuple(min(matrix[q][to] + costs[to] for to in range(STATES)) for q in range(STATES))
            rows >>= 1
            k += 1
        return costs


def _insertions(state: int, costs: tuple[int, ...], least: int) -> tuple[int, bool]:
    """The state after an insertion, and whether that is on a cheapest way."""
    to = _after(state, _FILL[state])
    return to, INSERT + costs[to] == least


def _letters_of_row(symbol: str, state: int, here: tuple[int, ...], then: tuple[int, ...], out: list[str]) -> int:
    """Take the least letters of a cheapest way over one row; the state behind it."""
    role, fault = symbol
    more = TRUNCATED if fault == "t" else 0
    while True:
        least = here[state]
        if DELETE + then[state] == least:
            out.append("D")
            return state
        to, fine = _insertions(state, here, least)
        if fine:
            out.append("I")
            state = to
            continue
        to = _after(state, role)
        if to >= 0 and more + then[to] == least:
            out.append("K")
            return to
        out.append("R")
        return _after(state, _FILL[state])


def _unroll(powers: Powers, symbol: str, rows: int, state: int, then: tuple[int, ...], out: list[str]) -> int:
    """The letters of a whole run, whose costs behind it are `then`."""
    open_ = [(rows, then)]
    while open_:
        rows, then = open_.pop()
        if rows == 1:
            state = _letters_of_row(symbol, state, powers.before(symbol, 1, then), then, out)
        else:
            second = 1 << (rows - 1).bit_length() - 1
            open_ += [(second, then), (rows - second, powers.before(symbol, second, then))]
    return state


def cheapest_edits(runs: list[tuple[str, int]], powers: Powers) -> tuple[int, str]:
    """Cost and letters of the edits of a conversation given as runs of (symbol, rows)."""
    costs = [end_costs()]
    for symbol, rows in reversed(runs):
        costs.append(powers.before(symbol, rows, costs[-1]))
    costs.reverse()
    out: list[str] = []
    state = 0
    for (symbol, rows), then in zip(runs, costs[1:], strict=True):
        state = _unroll(powers, symbol, rows, state, then, out)
    while costs[-1][state]:
        state, _ = _insertions(state, costs[-1], costs[-1][state])
        out.append("I")
    return costs[0][0], "".join(out)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, as conv_id, turn, role, text and the number of copies (0: dropped).

    The remainder of crc32(`conv_id:turn`) by 20 decides: 0 drops the row, 1 empties its text, 2 takes the
    ends of sentences out of it, 3 repeats it, 4 makes it the user's. A NULL is one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


ORDER = ["turn", "role", "digest"]


def mark_faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with `first` (none of its role and text came before), `blank` and `truncated`.

    Takes conv_id, turn, role, text and copies; rows of no copies stay, to keep their conversations.
    """
    names = ["conv_id", "role", "digest"]
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.where("copies > 0").groupBy(*names).agg(F.min(place)["turn"].alias("first_turn"))
    same: Column = F.lit(True)
    for n in names:
        same &= F.col(f"c.{n}").eqNullSafe(F.col(f"f.{n}"))
    return counted.alias("c").join(firsts.alias("f"), same, "left").select(
        "c.conv_id", "c.turn", "c.role", "c.digest", "c.text", "c.copies",
        F.col("c.turn").eqNullSafe(F.col("f.first_turn")).alias("first"),
        (~F.col("c.text").rlike(NOT_SPACE)).alias("blank"),
        (F.regexp_extract("c.text", rf"({NOT_SPACE})[\x20\x09-\x0D]*\z", 1).rlike(r"\A[^.!?]")).alias("truncated"))


def _initial(role: str) -> str:
    return role[:1] or " "


def _symbols(role: str, copies: int, first: bool, blank: bool, truncated: bool) -> list[tuple[str, int]]:
    who = _initial(role) if _initial(role) in "sua" else "-"
    stay = 1 if first and not blank else 0
    return [(s, n) for s, n in ((who + ("t" if truncated else "."), stay), (who + "x", copies - stay)) if n]


_SUMMARY = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
            ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its rows in order."""
    powers = Powers()
    done: list[tuple] = []
    id_type: pa.DataType = pa.null()
    open_ = False
    conversation, runs, counts, turns, before = None, [], [], [], ""

    def close() -> None:
        cost, audit = cheapest_edits(runs, powers)
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        done.append((conversation, gaps, *counts, cost, audit))

    def hand_on() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        out = pa.RecordBatch.from_arrays(
            [pa.array(columns[0], id_type), *[pa.array(c, t) for c, (_, t) in zip(columns[1:], _SUMMARY, strict=True)]],
            ["conv_id", *[n for n, _ in _SUMMARY]])
        done.clear()
        return out

    for batch in batches:
        id_type = batch.schema.field(0).type
        for conv, turn, role, copies, first, blank, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not open_ or conv != conversation:
                if open_:
                    close()
                open_, conversation, runs, counts, turns, before = True, conv, [], [0, 0, 0, 0], [], ""
            if not copies:
                continue
            if turn is not None:
                if not turns:
                    turns = [turn, turn, 1]
                elif turn != turns[1]:
                    turns[1:] = [turn, turns[2] + 1]
            kept_first = first and not blank
            counts[0] += copies if blank else 0
            counts[1] += 0 if blank else copies - kept_first
            counts[2] += bool(kept_first and truncated)
            who = _initial(role)
            counts[3] += (before != "" and before + who not in ("su", "ua", "au")) + copies - 1
            before = who
            for symbol, n in _symbols(role, copies, first, blank, truncated):
                if runs and runs[-1][0] == symbol:
                    runs[-1] = (symbol, runs[-1][1] + n)
                else:
                    runs.append((symbol, n))
        if done:
            yield hand_on()
    if open_:
        close()
        yield hand_on()


def find_edits(marked: DataFrame) -> DataFrame:
    """Per conversation its faults, the cost of its edits and their letters in order."""
    narrow = marked.select("conv_id", "turn", "role", "digest", "copies", "first", "blank", "truncated")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).drop("digest")
    kind = marked.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        _summaries, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


_REPAIRED = [("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows: each conversation's letters come first, its rows in order behind them."""
    conversation, audit, at, last, state, place = None, "", 0, 0, 0, 0
    for batch in batches:
        rows: list[tuple] = []
        for conv, letters, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if letters is not None:
                conversation, audit, at, state, place = conv, letters, 0, 0, 0
                last = len(audit.rstrip("I"))
                continue
            for _ in range(copies):
                taken = False
                while not taken or last <= at < len(audit):
                    letter = audit[at]
                    at += 1
                    taken |= letter != "I"
                    if letter != "D":
                        new = (_NAMES[_FILL[state]], "", None) if letter == "I" else (role if letter == "K" else _NAMES[_FILL[state]], text, turn)
                        state = _after(state, _initial(new[0]))
                        rows.append((conversation, place, new[2], new[0], new[1], letter))
                        place += 1
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type),
                 *[pa.array(c, t) for c, (_, t) in zip(columns[1:], _REPAIRED, strict=True)]],
                ["conv_id", *[n for n, _ in _REPAIRED]])


def repair(marked: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows of all repaired conversations: conv_id, place (from 0), turn (NULL where inserted), role, text, edit.

    A conversation's rows lie in order in one task.
    """
    none = lambda c: F.lit(None).cast(marked.schema[c].dataType).alias(c)
    letters = edits.select("conv_id", "audit", *map(none, [*ORDER, "text", "copies"]))
    rows = marked.where("copies > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), *ORDER, "text", "copies")
    ordered = letters.unionByName(rows).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("audit").isNull(), *ORDER).select("conv_id", "audit", "turn", "role", "text", "copies")
    kind = marked.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_apply, f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conversation, digest = None, None
    id_type: pa.DataType = pa.null()

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conversation], id_type), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        id_type = batch.schema.field(0).type
        for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if digest:
                    yield closed()
                conversation, digest = conv, hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if digest:
        yield closed()


def digest_repaired(repaired: DataFrame) -> DataFrame:
    """Per conversation that has repaired rows, the SHA-256 of its lines `role:text`, as `repair` deals and orders them."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.select("conv_id", "place", "role", "text").mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults and edits per conversation, and the repaired rows; takes conv_id, turn, role, text, copies."""
    marked = kept(mark_faults(rows))
    edits = kept(find_edits(marked))
    return edits, repair(marked, edits)


def with_digests(edits: DataFrame, repaired: DataFrame) -> DataFrame:
    """The edits of every conversation with the digest of its repaired rows."""
    digests = digest_repaired(repaired).withColumnRenamed("conv_id", "_conv")
    return edits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        *edits.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
