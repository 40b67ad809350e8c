from meterlake.llm.chat import END, START, preference_pairs, swapped_replies


def plain(turns):
    return "".join(f"{START}{r}\n{t}{END}\n" for r, t in turns)


def frame(spark, convs):
    rows = [(p, i, r, t, "x") for p, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, prompt string")


def test_longest_common_prefix_and_masks(spark):
    u, a = "user", "assistant"
    chosen = {1: [(u, "hi"), (a, "é yes"), (u, "and"), (a, "ok")], 2: [(u, "q")], 3: [(u, "q"), (a, "r")], 4: [(u, "x")], 5: [(a, None), (None, "<|im_end|>")]}
    rejected = {1: [(u, "hi"), (a, "no"), (u, "and")], 2: [(u, "q")], 3: [(u, "q")], 5: [(u, "z")], 9: [(u, "x")]}
    rows = {r.pair_id: r for r in preference_pairs(frame(spark, chosen), frame(spark, rejected)).collect()}
    assert set(rows) == {1, 2, 3, 5}
    for i, k in ((1, 1), (2, 1), (3, 1), (5, 0)):
        r = rows[i]
        assert r.prompt_turns == k
        if i != 5:
            assert r.prompt == plain(chosen[i][:k]) and r.chosen_completion == plain(chosen[i][k:]) and r.rejected_completion == plain(rejected[i][k:])
        for text, mask, turns in ((r.chosen_completion, r.chosen_mask, chosen[i][k:]), (r.rejected_completion, r.rejected_mask, rejected[i][k:])):
            assert [text[m.start : m.end] for m in mask] == [(t or "") + END for role, t in turns if role == a]
    assert rows[5].chosen_completion.count(END) == 2


def test_swapped(spark):
    conv = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 1, "assistant", "d"), (1, 2, "user", "e"), (4, 0, "system", "s"), (4, 1, "assistant", "t"), (6, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    chosen, rejected = swapped_replies(conv)
    rows = {r.pair_id: r for r in preference_pairs(chosen, rejected).collect()}
    assert set(rows) == {0, 1, 4} and rows[0].prompt_turns == 1
    assert rows[0].rejected_completion == plain([("assistant", "d")]) and rows[4].rejected_completion == plain([("assistant", "")])
    assert rows[1].chosen_completion == plain([("assistant", "d"), ("user", "e")])
    assert preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_null_pairs_repeated_turns_and_long_conversations(spark):
    schema = "pair_id long, turn long, role string, text string"
    long = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * 3) for i in range(3000)]
    chosen = spark.createDataFrame([(None, 0, "user", "x"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "b"), *long], schema)
    rejected = spark.createDataFrame([(None, 0, "user", "x"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "b"), *long[:-1], (7, 2999, "assistant", "other")], schema)
    rows = {r.pair_id: r for r in preference_pairs(chosen, rejected).collect()}
    assert set(rows) == {1, 7}
    assert rows[1].prompt_turns == 3 and rows[1].chosen_completion == "" and rows[1].prompt == plain([("assistant", "b"), ("user", "a"), ("user", "a")])
    assert rows[7].prompt_turns == 2999 and rows[7].prompt == plain([r[2:] for r in long[:-1]]) and rows[7].rejected_completion == plain([("assistant", "other")])
