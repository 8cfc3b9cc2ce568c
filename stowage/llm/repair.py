"""Conversation structure repair: the cheapest edits that bring a conversation's roles into the grammar (s?(ua)+)?.

Nodes are (turns consumed, grammar state); edges keep, rerole or delete the next turn, or insert a turn with an empty
text. Dijkstra expands them as they are reached, by (cost, audit) with the audit being the initials of the edits so far,
and stops at the first accepting end. Two audits that reach one node at one cost differ at some place (the longer of
two could only go on with insertions, which cost), so that what follows never turns their order.

A conversation of more than BLOCK turns is searched in blocks from each state that the block may begin in, and blocks
join by their end states, so that memory grows with a conversation's turns and not with their square. A conversation,
whose audit and repaired turns are one row of the result, is all that meets in one task.

Defined results: a null role or text is one space, and a null turn orders first; turns of one number are ordered by
role and text; rows of a null conversation are a conversation; one without turns needs no edit; an empty table gives an
empty result; other columns don't pass.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: state: {role initial: next state}; states are start, after system, after user, after assistant.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
FOLLOWS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 512
#: A turn's role initial, and what is wrong with it: "blank", "duplicate", "truncated" or "".
Turn = tuple[str, str]
LAST_INK = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text)."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        last = LAST_INK.search(row[1])
        out.append("blank" if not last else "duplicate" if row in seen else "truncated" if last[1] not in ".!?" else "")
        seen.add(row)
    return out


def edges(turns: list[Turn], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, turns consumed, state) of the edits at a node."""
    if i < len(turns):
        initial, fault = turns[i]
        yield DELETE, "D", i + 1, state
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault else 0
            if initial in GRAMMAR[state]:
                yield more, "K", i + 1, GRAMMAR[state][initial]
            for role in ROLES:
                if role in GRAMMAR[state]:
                    yield REROLE + more, "R", i + 1, GRAMMAR[state][role]
    for role in ROLES:
        if role in GRAMMAR[state]:
            yield INSERT, "I", i, GRAMMAR[state][role]


def search(turns: list[Turn], begin: int, ends: tuple[int, ...], all_ends: bool = False) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)} of the cheapest edits from state begin to the first of ends that is popped, or to all of them that can be reached."""
    heap, done, found = [(0, "", 0, begin)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ends:
            found[state] = (cost, audit)
            if not all_ends or len(found) == len(ends):
                break
        for more, initial, j, after in edges(turns, i, state):
            if (j, after) not in done:
                heapq.heappush(heap, (cost + more, audit + initial, j, after))
    return found


def cheapest(turns: list[Turn], block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of equals the least audit."""
    if len(turns) <= block:
        return next(iter(search(turns, 0, ACCEPTING).values()))
    best, states = {0: (0, "")}, tuple(range(len(GRAMMAR)))
    for at in range(0, len(turns), block):
        after: dict[int, tuple[int, str]] = {}
        for begin, (cost, audit) in best.items():
            for end, (more, letters) in search(turns[at : at + block], begin, states, True).items():
                key = (cost + more, audit + letters)
                after[end] = min(after.get(end, key), key)
        best = after
    return min(best[s] for s in ACCEPTING if s in best)


def applied(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired turns. The state names the role that an edit gives, since from each state one of user and assistant may follow."""
    out, i, state = [], 0, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        initial = rows[i][0][:1] if edit == "K" else next(r for r in ROLES if r in GRAMMAR[state])
        out.append(rows[i] if edit == "K" else (ROLES[initial], rows[i][1] if edit == "R" else ""))
        state, i = GRAMMAR[state][initial], i + (edit != "I")
    return out


def repaired(rows: list[tuple[int | None, str, str]]) -> dict:
    """All results of one conversation, from its (turn, role, text) in order."""
    numbers = {t for t, _, _ in rows if t is not None}
    said = [(role, text) for _, role, text in rows]
    wrong = faults(said)
    initials = [role[:1] for role, _ in said]
    cost, audit = cheapest(list(zip(initials, wrong, strict=True)))
    counts = {f: wrong.count(f) for f in ("blank", "duplicate", "truncated")}
    illegal = sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:]))
    turns = [{"role": role, "text": text} for role, text in applied(said, audit)]
    return {"gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired": turns}


def repair_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired array<struct<role, text>>), one row for each conversation.

    Rows where present isn't true are no turns, but their conversations are in the result.
    """
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), (one if present is None else F.when(present, one)).alias("one"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [repaired([(t["turn"], t["role"], t["text"]) for t in v.as_py()]) for v in b.column("turns")]
            columns = [pa.array([o[n] for o in out], pa.int64()) for n in names]
            columns += [pa.array([o["audit"] for o in out], pa.string()), pa.array([o["repaired"] for o in out], turn)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *columns], names=["conv_id", *names, "audit", "repaired"])

    kind = convs.schema["conv_id"].dataType.simpleString()
    return convs.mapInArrow(go, f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired array<struct<role:string,text:string>>")


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): turns with planted faults, drawn from a checksum of conversation and turn; for tests of repair on real turns.

    Of 20 draws 0 drops the turn, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    draw = (F.crc32(key.cast("binary")) % 20).alias("draw")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), draw)
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"), F.explode(times).alias("time"))
    return rows.drop("time")


def rendered(turns: Column) -> Column:
    """A line 'role:text' for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
