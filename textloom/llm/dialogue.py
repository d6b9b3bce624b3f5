"""Conversation structure repair (operator 13).

Turns are edited at least cost so that the initials of their roles give ``(s?(ua)+)?``: a turn is kept (0), given the role
user or assistant (2) or deleted (3), and an empty turn of user or assistant is put in anywhere (2). Blank and duplicate
turns must be deleted; a truncated one that stays adds 1. A backward pass over turns and grammar states gives the cost to
go; a forward walk takes, among the edits that keep to it, the one with the least letter. From a state each letter leads to
one state, so the walk's letters are the least of the cheapest in ASCII order. Edited turns are then rebuilt and hashed.

Scale: turns are range-partitioned and sorted by conversation and turn, so a long conversation lies in several tasks. Each
task cuts its turns in segments of at most ``SEGMENT_TURNS`` turns and ``SEGMENT_CHARS`` characters. The cost to go through a
segment is a min-plus matrix over the four states. Only conversations of several segments need more: their matrices are
folded from the end, each segment then tells where the walk leads from each state, and these maps are folded from the
start. Both folds read one row a segment, in streams. Duplicates are found by the digests that occur twice in a conversation.
The digest of a conversation is made by one task, as a stream over its segments, because a hash cannot be split.

Defined results: null roles, texts and, in the damage's key, ids and turns are one space; a null conversation id is a
conversation; null turns come first; rows of the same turn are taken by role, then text, then place; an empty table gives
an empty result; other columns are ignored; texts are read whole, and a worker needs a few times its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, materialise
from textloom.llm.fragments import release

SEGMENT_TURNS = 4096
SEGMENT_CHARS = 1 << 21
#: Turns in a range partition, on average, and segments in a batch of rows at most.
PARTITION_TURNS, _TOGETHER = 20_000, 64
DROP, EMPTY, UNPOINTED, REPEAT, AS_USER = 0, 1, 2, 3, 4
CHANCES = 20
#: What a turn is; a dropped turn stays as a row so that its conversation is known.
SOUND, BLANK, DUPLICATE, TRUNCATED, DROPPED = 0, 1, 2, 3, 4
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1

#: Grammar states: nothing yet, after s, after u, after a. A pass may end where nothing or an answer was the last.
STATES = 4
ENDS = (0, 3)
#: The state after a role's initial; from each state exactly one of u and a is possible.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEEDED = ("user", "user", "assistant", "user")
FORCED = [NEXT[q][NEEDED[q][0]] for q in range(STATES)]
FAR = 1 << 60


def taken(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, dropped) of the rows; null roles and texts are one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))]
    return df.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), *filled, F.lit(False).alias("dropped"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``taken`` after the damage that the checksum of ``conv_id:turn`` chooses."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")])
    rows = rows.withColumn("what", (F.crc32(key.cast("binary")) % CHANCES).cast("int"))
    what = F.col("what")
    once, twice = F.array(F.lit(0)), F.array(F.lit(0), F.lit(1))
    return rows.select(
        "conv",
        "turn",
        F.when(what == AS_USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(what == EMPTY, "").when(what == UNPOINTED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (what == DROP).alias("dropped"),
        F.explode(F.when(what == REPEAT, twice).otherwise(once)).alias("copy"),
    ).drop("copy")


def faulted(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, place, kind): each turn's first fault; ``rows`` as of ``damaged``."""
    solid = rf"[^{SPACE}]"
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    kind = F.when(F.col("dropped"), DROPPED).when(~F.col("text").rlike(solid), BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    marked = materialise(rows.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place"), kind.alias("kind"), F.when(kind.isin(SOUND, TRUNCATED), digest).alias("digest")), "dialogue-turns")
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "place")
    twice = marked.filter(F.col("digest").isNotNull()).groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = marked.join(twice, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("first.place") != F.col("place"), F.lit(False))
    return joined.select("conv", "turn", "role", "text", "place", F.when(again, DUPLICATE).otherwise(F.col("kind")).alias("kind"))


def _settled(cost: list[int]) -> list[int]:
    """Costs to go by state when turns may be put in first; two in a row are the most that can pay."""
    for _ in range(2):
        cost = [min(c, cost[FORCED[q]] + INSERT_COST) for q, c in enumerate(cost)]
    return cost


def _before(kind: int, initial: str, cost: list[int]) -> list[int]:
    """Costs to go in front of a turn from those behind it."""
    best = [c + DELETE_COST for c in cost]
    if kind in (SOUND, TRUNCATED):
        stays = TRUNCATED_COST if kind == TRUNCATED else 0
        for q in range(STATES):
            best[q] = min(best[q], cost[FORCED[q]] + REROLE_COST + stays)
            if initial in NEXT[q]:
                best[q] = min(best[q], cost[NEXT[q][initial]] + KEEP_COST + stays)
    return _settled(best)


#: Costs to go behind the last turn.
LAST = _settled([0 if q in ENDS else FAR for q in range(STATES)])


def to_go(kinds: list[int], initials: list[str], behind: list[int]) -> list[list[int]]:
    """The costs to go in front of each turn, and behind the last one."""
    costs = [behind]
    for kind, initial in zip(reversed(kinds), reversed(initials), strict=True):
        costs.append(_before(kind, initial, costs[-1]))
    return costs[::-1]


def passage(kinds: list[int], initials: list[str]) -> list[list[int]]:
    """matrix[q][r]: the least cost from state q before the turns to state r behind them."""
    to = [to_go(kinds, initials, [0 if q == r else FAR for q in range(STATES)])[0] for r in range(STATES)]
    return [[min(to[r][q], FAR) for r in range(STATES)] for q in range(STATES)]


def through(matrix: list[list[int]], behind: list[int]) -> list[int]:
    """Costs to go in front of turns with this matrix."""
    return [min(c + b for c, b in zip(row, behind, strict=True)) for row in matrix]


def walk(kinds: list[int], initials: list[str], costs: list[list[int]], states: list[int]) -> list[tuple[int, str, list[str | None]]]:
    """From each state: the state behind the turns, the letters of the edits, and for each letter the role it gives.

    ``costs`` are those of ``to_go``; a kept turn gives no role.
    """
    out = []
    for q in states:
        letters, roles = [], []
        for i, (kind, initial) in enumerate(zip(kinds, initials, strict=True)):
            here, after = costs[i], costs[i + 1]
            stays = TRUNCATED_COST if kind == TRUNCATED else 0
            while after[q] + DELETE_COST != here[q] and here[FORCED[q]] + INSERT_COST == here[q]:
                letters.append("I")
                roles.append(NEEDED[q])
                q = FORCED[q]
            if after[q] + DELETE_COST == here[q]:
                letters.append("D")
                roles.append(None)
            elif kind in (SOUND, TRUNCATED) and initial in NEXT[q] and after[NEXT[q][initial]] + KEEP_COST + stays == here[q]:
                letters.append("K")
                roles.append(None)
                q = NEXT[q][initial]
            else:
                letters.append("R")
                roles.append(NEEDED[q])
                q = FORCED[q]
        out.append((q, "".join(letters), roles))
    return out


def finish(state: int) -> list[str]:
    """The roles of the turns that are put in behind the last one."""
    out = []
    while state not in ENDS:
        out.append(NEEDED[state])
        state = FORCED[state]
    return out


def _rebuilt(roles: list[str], texts: list[str], letters: str, given: list[str | None]) -> str:
    """The turns after the edits, each ended by a newline."""
    out, at = [], 0
    for letter, role in zip(letters, given, strict=True):
        if letter == "I":
            out.append(f"{role}:\n")
            continue
        if letter != "D":
            out.append(f"{role or roles[at]}:{texts[at]}\n")
        at += 1
    return "".join(out)


_WHERE = {"part": "int", "segment": "int", "conv": "{conv}"}
_FIGURES = {"blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first": "string", "last": "string", "low": "long", "high": "long", "turns": "long"}
_SEGMENT = _WHERE | {"whole": "boolean", "roles": "array<string>", "texts": "array<string>", "kinds": "array<int>", "costs": "array<long>"} | _FIGURES
_EDITED = _WHERE | _FIGURES | {"audit": "string", "repaired": "string", "cost": "long", "state": "int"}
_RESULT = {"conv_id": "{conv}", "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _ddl(fields: dict[str, str], conv: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items()).replace("{conv}", conv)


def _batch(rows: list[dict], fields: dict[str, str], conv: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, _ARROW.get(kind, conv)) for name, kind in fields.items()]))


_LEGAL = {"su", "ua", "au"}


def _segment(part: int, number: int, whole: bool, conv: object, turns: list[tuple]) -> dict:
    """A row for turns of one conversation in order; turns: (turn, role, text, kind)."""
    here = [t for t in turns if t[3] != DROPPED]
    initials, numbers = [t[1][:1] for t in here], [t[0] for t in here if t[0] is not None]
    kinds = [t[3] for t in here]
    row = {"part": part, "segment": number, "whole": whole, "conv": conv, "roles": [t[1] for t in here], "texts": [t[2] for t in here], "kinds": kinds}
    row["costs"] = [] if whole else sum(passage(kinds, initials), [])
    row |= {name: kinds.count(k) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    row["illegal"] = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    row |= {"first": initials[0] if here else None, "last": initials[-1] if here else None}
    return row | {"low": min(numbers, default=None), "high": max(numbers, default=None), "turns": len(set(numbers))}


def segments(turns: DataFrame, partition_turns: int, segment_turns: int, segment_chars: int) -> DataFrame:
    """Turns in order as segments; a segment is ``whole`` if it surely holds all of its conversation."""
    n = turns.count()
    sort = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("place")]
    ranged = turns.repartitionByRange(max(1, -(-n // partition_turns)), *sort).sortWithinPartitions(*sort)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, number, held, chars, conv, kind = TaskContext.get().partitionId(), 0, [], 0, None, pa.null()
        opened = True  # the task before may have begun with this conversation
        rows, size = [], 0
        for batch in batches:
            kind = batch.schema.field("conv").type
            for c, *turn in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "kind")), strict=True):
                if held and (c != conv or len(held) >= segment_turns or chars >= segment_chars):
                    ends = c != conv
                    rows.append(_segment(part, number, ends and not opened, conv, held))
                    size += chars
                    if len(rows) >= _TOGETHER or size >= segment_chars:
                        yield _batch(rows, _SEGMENT, kind)
                        rows, size = [], 0
                    number, held, chars, opened = number + 1, [], 0, not ends
                conv = c
                held.append(tuple(turn))
                chars += len(turn[2])
        if held:  # the next task may go on with this conversation
            rows.append(_segment(part, number, False, conv, held))
        if rows:
            yield _batch(rows, _SEGMENT, kind)

    return ranged.mapInArrow(run, _ddl(_SEGMENT, turns.schema["conv"].dataType.simpleString()))


def _streamed(rows: DataFrame, step: Callable[[dict, object], tuple[dict, object]], fields: dict[str, str], backward: bool = False) -> DataFrame:
    """A fold over each conversation's segments in order: ``step`` turns a row and what was carried into the two again."""
    order = [F.col("conv"), *(F.col(c).desc() if backward else F.col(c) for c in ("part", "segment"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, carried, first = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if first or row["conv"] != conv:
                    conv, carried, first = row["conv"], None, False
                done, carried = step(row, carried)
                out.append(done)
            yield _batch(out, fields, batch.schema.field("conv").type)

    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, _ddl(fields, rows.schema["conv"].dataType.simpleString()))


def _behind(row: dict, carried: object) -> tuple[dict, object]:
    cost = LAST if carried is None else carried
    matrix = [row["costs"][q * STATES : (q + 1) * STATES] for q in range(STATES)]
    return {**{c: row[c] for c in _WHERE}, "behind": cost}, through(matrix, cost)


def _start(row: dict, carried: object) -> tuple[dict, object]:
    state = 0 if carried is None else carried
    return {**{c: row[c] for c in _WHERE}, "behind": row["behind"], "start": state}, row["leads"][state]


def _initials(roles: list[str]) -> list[str]:
    return [r[:1] for r in roles]


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            kinds, initials = row.pop("kinds"), row.pop("initials")
            row["leads"] = [q for q, _, _ in walk(kinds, initials, to_go(kinds, initials, row["behind"]), list(range(STATES)))]
        yield _batch(rows, _LEADS, batch.schema.field("conv").type)


_BEHIND = _WHERE | {"behind": "array<long>"}
_LEADS = _BEHIND | {"leads": "array<int>"}
_START = _BEHIND | {"start": "int"}


def _edited(row: dict) -> dict:
    """A segment after its edits, given the costs behind it and the state in front of it."""
    initials = _initials(row["roles"])
    costs = to_go(row["kinds"], initials, row["behind"])
    [(state, letters, given)] = walk(row["kinds"], initials, costs, [row["start"]])
    out = {name: row[name] for name in (*_WHERE, *_FIGURES)}
    return out | {"audit": letters, "repaired": _rebuilt(row["roles"], row["texts"], letters, given), "cost": costs[0][row["start"]] - costs[-1][state], "state": state}


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TOGETHER):
            yield _batch([_edited(row) for row in batch.slice(at, _TOGETHER).to_pylist()], _EDITED, batch.schema.field("conv").type)


class _Digest:
    """Figures of a conversation from its edited segments in order."""

    def __init__(self, conv: object):
        self.row = {"conv_id": conv} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.sha, self.audit, self.held, self.state = hashlib.sha256(), [], "", 0
        self.last = self.low = self.high = None
        self.turns = 0

    def add(self, row: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
            self.row[name] += row[name]
        if row["first"] is not None:
            self.row["illegal"] += self.last is not None and self.last + row["first"] not in _LEGAL
            self.last = row["last"]
        if row["low"] is not None:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        self.audit.append(row["audit"])
        self.feed(row["repaired"])
        self.state = row["state"]

    def feed(self, lines: str) -> None:
        """Hash all but the last newline, which only stands if more follows."""
        if lines:
            self.sha.update((self.held + lines[:-1]).encode("utf-8", "surrogatepass"))
            self.held = "\n"

    def close(self) -> dict:
        added = finish(self.state)
        self.feed("".join(f"{role}:\n" for role in added))
        self.row["cost"] += INSERT_COST * len(added)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.row | {"gaps": gaps, "audit": "".join(self.audit) + "I" * len(added), "repaired_sha256": self.sha.hexdigest()}


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation; its segments come in a row."""
    now, kind, done = None, pa.null(), []
    for batch in batches:
        kind = batch.schema.field("conv").type
        for row in batch.to_pylist():
            if now is None or row["conv"] != now.row["conv_id"]:
                if now is not None:
                    done.append(now.close())
                now = _Digest(row["conv"])
            now.add(row)
        yield _batch(done, _RESULT, kind)
        done = []
    if now is not None:
        yield _batch([now.close()], _RESULT, kind)


def edited(turns: DataFrame, partition_turns: int = PARTITION_TURNS, segment_turns: int = SEGMENT_TURNS, segment_chars: int = SEGMENT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Edited segments of ``faulted`` turns: those that are whole conversations, and those of several segments."""
    kind = turns.schema["conv"].dataType.simpleString()
    kept = materialise(segments(turns, partition_turns, segment_turns, segment_chars), "dialogue-segments")
    whole = kept.filter("whole").withColumns({"behind": F.lit(LAST).cast("array<long>"), "start": F.lit(0)})
    several = kept.filter("not whole")
    behind = _streamed(several.select(*_WHERE, "costs"), _behind, _BEHIND, backward=True)
    narrow = several.select("part", "segment", "kinds", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"))
    leads = narrow.join(behind, ["part", "segment"]).select(*_BEHIND, "kinds", "initials").mapInArrow(_leads, _ddl(_LEADS, kind))
    starts = _streamed(leads, _start, _START).drop("conv")
    ddl = _ddl(_EDITED, kind)
    return whole.mapInArrow(_edit, ddl), several.join(starts, ["part", "segment"]).mapInArrow(_edit, ddl)


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **sizes: int) -> DataFrame:
    """Edited segments of the rows of ``df`` as they are: conv, part, segment, audit letters and the repaired turns."""
    whole, several = edited(faulted(taken(df, conv_id, turn, role, text)), **sizes)
    return whole.unionByName(several).select("conv", "part", "segment", "audit", "repaired", "cost", "state")


def report(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **sizes: int) -> DataFrame:
    """Damage the rows of ``df``, repair them, and give each conversation's faults, edits and digest."""
    whole, several = edited(faulted(damaged(taken(df, conv_id, turn, role, text))), **sizes)
    ddl = _ddl(_RESULT, whole.schema["conv"].dataType.simpleString())
    in_order = several.repartition("conv").sortWithinPartitions("conv", "part", "segment")
    return whole.mapInArrow(_digested, ddl).unionByName(in_order.mapInArrow(_digested, ddl))
