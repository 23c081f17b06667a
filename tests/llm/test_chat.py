from lattica.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, side string, t string"


def run(spark, rows, pairs=None):
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    pairs = chat.adjacent_pairs(turns) if pairs is None else spark.createDataFrame(pairs, "pair_id long, chosen long, rejected long")
    return {r["pair_id"]: r for r in chat.preferences(turns, pairs).collect()}


def test_prefix_prompt_and_masks(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad é"), (1, 2, "user", "why")]
    row = run(spark, rows)[0]
    assert row["prefix_turns"] == 1 and row["prompt"] == "<|user|>\nhi<|end|>\n"
    assert row["chosen"] == "<|assistant|>\ngood<|end|>\n"
    assert [row["chosen"][s["start"] : s["end"]] for s in row["chosen_spans"]] == ["good<|end|>\n"]
    assert [row["rejected"][s["start"] : s["end"]] for s in row["rejected_spans"]] == ["bad é<|end|>\n"]


def test_no_prefix_one_inside_the_other_and_equal(spark):
    rows = [(0, 0, "user", "a"), (1, 0, "user", "b")]
    rows += [(2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "c")]
    rows += [(4, 0, "user", "a"), (5, 0, "user", "a")]
    out = run(spark, rows)
    assert out[0]["prefix_turns"] == 0 and out[0]["prompt"] == ""
    assert out[1]["prefix_turns"] == 1 and out[1]["chosen"] == "" and out[1]["rejected_spans"]
    assert out[2]["prefix_turns"] == 1 and out[2]["chosen"] == out[2]["rejected"] == ""


def test_nulls_repeats_and_missing_sides(spark):
    rows = [(0, 0, "user", None), (0, 0, "user", None), (1, 0, "user", ""), (1, None, "user", "z"), (None, 0, "user", "z"), (7, 0, None, "q")]
    out = run(spark, rows)
    assert list(out) == [0] and out[0]["prefix_turns"] == 1
    assert run(spark, rows, [(1, 0, 99)]) == {}
    assert run(spark, []) == {}


def test_long_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t < 1500 else f"{c}") for c in (0, 1) for t in range(2000)]
    row = run(spark, rows)[0]
    assert row["prefix_turns"] == 1500 and len(row["chosen_spans"]) == 250


def test_pairs_of_ids_beyond_doubles(spark):
    first = 2**60
    rows = [(first + k, 0, "user", f"t{k}") for k in range(6)] + [(-2, 0, "user", "a"), (-1, 0, "user", "b")]
    out = run(spark, rows)
    got = {k: (r["chosen_id"], r["rejected_id"]) for k, r in out.items()}
    assert got == {-1: (-2, -1), **{first // 2 + k: (first + 2 * k, first + 2 * k + 1) for k in range(3)}}
