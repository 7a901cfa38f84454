"""Repair of conversation structure: the cheapest edits that give well-formed roles, as a stream over sorted turns.

A conversation is well-formed when the first letters of its roles read
``(s?(ua)+)?``: nothing, or an optional system turn and then user and assistant
in turns. Edits: K keeps a turn (cost 0), R gives it the role user or assistant
(2), D deletes it (3), I inserts an empty user or assistant turn (2). A blank or
duplicate turn must be deleted; a truncated one that is not deleted adds 1. Of
equally cheap edits those whose letters come first in ASCII order are taken.

The turns are partitioned by conversation once and sorted twice inside their
partitions, so a conversation of any length passes through one task as a stream:

* last turn first, ``mapInPandas`` carries the cost to the end from each of the
  four states of the grammar across Arrow batches, and writes beside each turn
  16 bits of backpointers: for each state the inserts before the turn and its
  edit. Costs to the end, not from the start, make the least letters a choice
  at each turn;
* first turn first, a second pass follows the pointers and gives the edits.

The pointers travel in the rows, so Spark's external sort spills them for giant
conversations; what a task holds is one batch and four numbers.
:func:`summary` is a third stream over the edits, one row per conversation.

Defined results: a null text or role is one space (so the text is blank); an
empty role, or one that starts with another letter, can only be replaced or
deleted; turns come in order of turn (null first), then role, then text; a null
conv_id is a conversation of its own; a turn is a duplicate when role and text
were seen earlier in its conversation, in whatever fault class; of several
faults the first of blank, duplicate, truncated counts; repeated rows are
duplicates; texts of any length are kept whole; other columns are ignored; an
empty table gives no rows. Only the audit of a conversation, a letter per edit,
is held as a whole by :func:`summary`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
#: Kinds of a turn: faults × first letters.
FAULTS = ("", "blank", "duplicate", "truncated")
LETTERS = ("", "s", "u", "a")

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_SAID = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}  # (state, letter) → state
_NEXT = (2, 2, 3, 2)  # the state after the user or assistant turn that must follow, if any does
_ROLE = ("user", "user", "assistant", "user")  # its role, by the state before
_END = (0, 2 * INSERT, INSERT, 0)  # cost of the inserts that end a conversation
_EDITS = "DKR"

_POINTERS = "conv string, numbered boolean, turn long, role string, text string, nth int, fault int, points int"
_ROWS = "conv string, place long, turn long, edit string, fault string, was string, role string, text string, cost int"
_SUMMARY = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired_sha256 string")


def _step(after: tuple[int, ...], fault: int, letter: int) -> tuple[int, tuple[int, ...]]:
    """Backpointers of a turn, and the costs to the end before it from those after it (less their minimum)."""
    options: list[list[tuple[int, str, int]]] = []  # per state: (cost, edits in letters, code)
    for s in range(4):
        found = [(DELETE + after[s], "D", 0)]
        if fault not in (1, 2):
            extra = TRUNCATED if fault == 3 else 0
            if (s, letter) in _SAID:
                found.append((KEEP + extra + after[_SAID[s, letter]], "K", 1))
            found.append((REROLE + extra + after[_NEXT[s]], "R", 2))
        options.append(found)
    best = []
    for s in range(4):  # up to two inserts before the turn: a third would only go round
        one, two = _NEXT[s], _NEXT[_NEXT[s]]
        best.append(min(options[s] + [(INSERT + c, "I" + e, 4 + k) for c, e, k in options[one]]
                        + [(2 * INSERT + c, "II" + e, 8 + k) for c, e, k in options[two]]))
    low = min(b[0] for b in best)
    return sum(b[2] << 4 * s for s, b in enumerate(best)), tuple(b[0] - low for b in best)


def _point(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, tuple] = {}  # the costs differ by little, so few cases occur
    key: object = object()
    costs = _END
    for frame in frames:
        points = []
        for conv, fault, letter in zip(frame["conv"], frame["fault"], frame["letter"]):
            if conv != key:
                key, costs = conv, _END
            case = (costs, fault, letter)
            if case not in known:
                known[case] = _step(*case)
            code, costs = known[case]
            points.append(code)
        yield frame.drop(columns="letter").assign(points=points)
    give_back()


def _follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    key: object = object()
    state = place = 0
    rows: list[tuple] = []

    def add(turn, edit, fault, was, role, text, cost):
        nonlocal place
        rows.append((key, place, turn, edit, fault, was, role, text, cost))
        place += 1

    def insert():
        nonlocal state
        add(None, "I", None, None, _ROLE[state], "", INSERT)
        state = _NEXT[state]

    def end():
        nonlocal state, place
        for _ in range(_END[state] // INSERT):
            insert()
        state = place = 0

    def table() -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=columns)
        frame["turn"] = pd.array(frame["turn"].tolist(), "Int64")
        rows.clear()
        return frame

    for frame in frames:
        for conv, numbered, turn, role, text, fault, points in zip(*(frame[c] for c in ("conv", "numbered", "turn", "role", "text", "fault", "points"))):
            if conv != key:
                end()
                key = conv
            code = int(points) >> 4 * state & 15
            for _ in range(code >> 2):
                insert()
            edit = _EDITS[code & 3]
            name = FAULTS[fault] or None
            extra = TRUNCATED if name == "truncated" else 0
            turn = int(turn) if numbered else None
            if edit == "D":
                add(turn, "D", name, role, None, None, DELETE)
            elif edit == "K":
                add(turn, "K", name, role, role, text, KEEP + extra)
                state = _SAID[state, LETTERS.index(role[:1])]
            else:
                add(turn, "R", name, role, _ROLE[state], text, REROLE + extra)
                state = _NEXT[state]
        yield table()
    end()
    yield table()
    give_back()


def edits(turns: DataFrame) -> DataFrame:
    """The edits of each conversation of ``turns`` (conv_id, turn, role, text), in order inside their partition.

    One row per edit: conv_id (as text), place (0, 1, …), turn, edit (K, R, D or
    I), fault, was (the role before; null for an insert), role and text after
    (null for a deleted turn), cost.
    """
    ship_package(turns.sparkSession)
    said = turns.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").isNotNull().alias("numbered"),
                        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),  # a null among longs would make them floats in pandas
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    again = Window.partitionBy("conv", "role", "text").orderBy("numbered", "turn")
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (F.when(body == "", 1).when(F.col("nth") > 1, 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0))
    first = F.left("role", F.lit(1))
    letter = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    known = (said.repartition("conv").withColumn("nth", F.row_number().over(again))  # the window keeps the partitions
             .withColumn("fault", fault).withColumn("letter", letter))
    last_first = known.sortWithinPartitions("conv", F.desc("numbered"), F.desc("turn"), F.desc("role"), F.desc("text"), F.desc("nth"))
    pointed = last_first.mapInPandas(_point, _POINTERS)
    first_first = pointed.sortWithinPartitions("conv", "numbered", "turn", "role", "text", "nth")
    return first_first.mapInPandas(_follow, _ROWS)


def _sum_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _SUMMARY.split(", ")]
    legal = {"su", "ua", "au"}
    key: object = object()
    done: list[tuple] = []

    def start():
        return {"audit": [], "sha": hashlib.sha256(), "said": False, "before": None, "low": None, "high": None, "turns": 0, "cost": 0,
                "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0}

    def end():
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        done.append((key, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()))

    s = None
    for frame in frames:
        for conv, numbered, turn, edit, fault, was, role, text, cost in zip(*(frame[c] for c in (
                "conv", "numbered", "turn", "edit", "fault", "was", "role", "text", "cost"))):
            if s is None or conv != key:
                if s is not None:
                    end()
                key, s = conv, start()
            s["audit"].append(edit)
            s["cost"] += int(cost)
            if fault is not None:
                s[fault] += 1
            if was is not None:
                if s["before"] is not None and s["before"] + was[:1] not in legal:
                    s["illegal"] += 1
                s["before"] = was[:1]
            if numbered:
                if turn != s["high"]:
                    s["turns"] += 1
                s["low"], s["high"] = int(turn) if s["low"] is None else s["low"], int(turn)
            if role is not None:
                s["sha"].update(f"{chr(10) if s['said'] else ''}{role}:{text}".encode())
                s["said"] = True
        if done:
            yield pd.DataFrame(done, columns=columns)
            done.clear()
    if s is not None:
        end()
        yield pd.DataFrame(done, columns=columns)


def summary(edited: DataFrame) -> DataFrame:
    """One row per conversation of :func:`edits`: gaps in its turns, faults, role changes that are not well-formed
    (``illegal``), cost, the edits' letters (``audit``) and the digest of its repaired ``role:text`` lines."""
    ship_package(edited.sparkSession)
    numbered = edited.withColumn("numbered", F.col("turn").isNotNull()).withColumn("turn", F.coalesce("turn", F.lit(0)))
    return numbered.mapInPandas(_sum_up, _SUMMARY)


def repaired(edited: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id (as text), place, role, text."""
    return edited.where(F.col("role").isNotNull()).select(F.col("conv").alias("conv_id"), "place", "role", "text")
