import hashlib
import random

from stowage.llm import preferences

TURN = "conv_id long, turn long, role string, text string, LAST int"


def test_prompt_and_masks(spark):
    a = [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "good")]
    b = [("user", "q"), ("assistant", "a"), ("user", "s"), ("assistant", "bad")]
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, b), (4, a, a[:2])], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = {r["pair_id"]: r for r in preferences.format_preferences(df).collect()}
    r = out[1]
    assert (r["n_common"], r["prompt"]) == (2, "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n") and r["rejected"].startswith("<|user|>\ns")
    sizes = [int(p.split(":")[0]) for p in r["chosen_mask"].split()]
    assert sum(sizes) == len(r["chosen"]) and [p[-1] for p in r["chosen_mask"].split()] == ["0", "1"]
    assert (out[2]["n_common"], out[2]["chosen"], out[2]["rejected"]) == (4, "", "")
    assert out[3]["prompt"] == "" and out[3]["chosen"] == "" and out[3]["rejected"] != ""
    assert out[4]["n_common"] == 2 and out[4]["rejected"] == "" and out[4]["rejected_mask"] == ""


def test_contrast_pairs(spark):
    rows = [(2, 1, "assistant", "x", 0), (2, 0, "user", "q", 0), (3, 0, "user", "p", 0), (3, 1, "assistant", "y", 0), (3, 2, "user", "late", 0), (4, 0, "user", "alone", 0), (5, 0, "user", "u", 0), (5, 1, "assistant", None, 0), (None, 0, "user", "n", 0)]
    df = spark.createDataFrame(rows, TURN)
    out = {r["pair_id"]: r for r in preferences.contrast_pairs(df).collect()}
    assert set(out) == {2, 3, 5}
    text = lambda i, side: [t["text"] for t in out[i][side]]
    assert text(2, "rejected") == ["q", "y"] and text(3, "chosen") == ["p", "y"] and text(3, "rejected") == ["p", ""] and text(5, "rejected") == ["u", "x"]
    assert preferences.contrast_pairs(df.limit(0)).count() == 0


def test_every_answer_has_a_pair_and_none_its_own(spark):
    """Rings against a walk around them; equal answers stand next to each other, also across the end."""
    rng = random.Random(6)
    answers = {i: rng.choice("aaab") for i in rng.sample(range(500), 120)}
    df = spark.createDataFrame([(i, 0, "assistant", a, 0) for i, a in answers.items()] * 2 + [(i, 1, "user", "later", 0) for i in answers], TURN)
    for ring in (7, 40, 10**6):
        out = {r["pair_id"]: r for r in preferences.contrast_pairs(df, ring=ring).collect()}
        n = -(-2 * len(answers) // ring)
        assert set(out) == set(answers)
        for i, r in out.items():
            of = lambda j: int(hashlib.md5(str(j).encode()).hexdigest()[:8], 16) % n
            own = sorted(j for j in answers if of(j) == of(i))
            after = [j for j in own if j > i] + [j for j in own if j < i]
            want = next(([answers[i], answers[j]] for j in after if answers[j] != answers[i]), [answers[i]])
            assert [t["text"] for t in r["rejected"]] == want
    same = spark.createDataFrame([(1, 0, "user", "q", 0), (1, 1, "assistant", "a", 0), (2, 0, "assistant", "a", 0)], TURN)
    alone = {r["pair_id"]: r for r in preferences.format_preferences(preferences.contrast_pairs(same)).collect()}
    assert alone[1]["prompt"] == "<|user|>\nq<|end|>\n" and alone[1]["rejected"] == "" and alone[2]["chosen"] == "<|assistant|>\na<|end|>\n"
