import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from stowage.llm import repair

TURN = "conv_id long, turn long, role string, text string, COST int"


def by_hand(turns, deep=3):
    """(cost, audit) over all sequences of edits with at most `deep` insertions in a row, by the grammar's pattern alone."""
    best = None
    gaps = [p for n in range(deep + 1) for p in itertools.product("ua", repeat=n)]
    for moves in itertools.product("DKR", repeat=len(turns)):
        if any(m != "D" and t[1] in ("blank", "duplicate") for m, t in zip(moves, turns, strict=True)):
            continue
        for roles in itertools.product(*[{"D": [""], "K": [t[0]], "R": ["u", "a"]}[m] for m, t in zip(moves, turns, strict=True)]):
            cost = sum({"D": 4, "K": 0, "R": 3}[m] + (3 if m != "D" and t[1] else 0) for m, t in zip(moves, turns, strict=True))
            for fill in itertools.product(gaps, repeat=len(turns) + 1):
                said = "".join(fill[0]) + "".join(r + "".join(f) for r, f in zip(roles, fill[1:], strict=True))
                if re.fullmatch("(s?(ua)+)?", said):
                    audit = "I" * len(fill[0]) + "".join(m + "I" * len(f) for m, f in zip(moves, fill[1:], strict=True))
                    key = (cost + 3 * sum(map(len, fill)), audit)
                    best = min(best or key, key)
    return best


def test_cheapest_against_all_edits():
    rng = random.Random(3)
    cases = [[(rng.choice("suuaat "), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(4))] for _ in range(60)]
    for turns in cases:
        assert repair.cheapest(turns) == by_hand(turns, 2), turns


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_give_the_same(block):
    rng = random.Random(block)
    for _ in range(200):
        turns = [(rng.choice("suuaa?"), rng.choice(["", "", "", "truncated", "blank"])) for _ in range(rng.randrange(40))]
        assert repair.cheapest(turns, block) == repair.cheapest(turns, 100)


def test_a_long_conversation_takes_memory_by_turns():
    rng = random.Random(1)
    turns = [("ua"[i % 2] if rng.random() < 0.9 else "s", "truncated" if rng.random() < 0.1 else "") for i in range(6000)]
    cost, audit = repair.cheapest(turns)
    assert len(audit.replace("I", "")) == 6000 and cost > 0


def test_results_and_grammar(spark):
    rows = [
        (1, 0, "system", "Be kind.", 0), (1, 1, "user", "Hi?", 0), (1, 2, "assistant", "Yes.", 0),
        (2, 5, "assistant", "First.", 0), (2, 7, "user", "  ", 0), (2, 7, "user", "No end", 0), (2, 9, "assistant", "First.", 0),
        (3, None, None, None, 0), (3, None, "user", "A.", 0), (3, 4, "user", "A.", 0), (3, 4, "user", "A.", 0),
        (None, 1, "user", "Q.", 0), (4, None, "tool", "T.", 0),
    ]
    out = {r["conv_id"]: r for r in repair.repair_conversations(spark.createDataFrame(rows, TURN)).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    assert (out[1]["cost"], out[1]["audit"], out[1]["illegal"], out[1]["gaps"]) == (0, "KKK", 0, 0)
    r = out[2]
    assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"]) == (2, 1, 1, 1) and r["illegal"] == 1
    assert (r["cost"], r["audit"]) == (3 + 4 + 4 + 4, "IKDDD")
    assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["repaired"]))
    # nulls are one space: a blank row; equal rows of one turn number are an original and its copies
    assert (out[3]["gaps"], out[3]["blank"], out[3]["duplicate"], out[3]["cost"]) == (0, 1, 2, 4 + 4 + 4 + 3)
    assert [t["role"] for t in out[3]["repaired"]] == ["user", "assistant"]
    assert (out[4]["gaps"], out[4]["audit"], out[4]["cost"]) == (0, "D", 4) and out[4]["repaired"] == []
    assert out[None]["audit"] == "KI"


def test_dropped_turns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "Q.", 0), (2, 0, "user", "Q.", 0)], TURN)
    out = {r["conv_id"]: r for r in repair.repair_conversations(df, present=F.col("conv_id") == 2).collect()}
    assert (out[1]["cost"], out[1]["audit"], out[1]["repaired"], out[1]["gaps"]) == (0, "", [], 0) and out[2]["audit"] == "KI"
    assert repair.repair_conversations(df.limit(0)).count() == 0 and repair.damaged(df.limit(0)).count() == 0


def test_damage_by_its_draw(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!", 0) for c in range(40) for t in (0, 1, None)]
    out = {}
    for r in repair.damaged(spark.createDataFrame(rows, TURN)).collect():
        out.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["present"]))
    seen = set()
    for c, t, _, text, _ in rows:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        seen.add(k)
        one = ("user" if k == 4 else "assistant", "" if k == 1 else "One Two" if k == 2 else text, k != 0)
        assert out[c, t] == [one] * (2 if k == 3 else 1)
    assert {0, 1, 2, 3, 4} <= seen
