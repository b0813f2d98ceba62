import edge
from compare import SF_DIR, differences, engine
from tablegauge.llm import preference, queries

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "é😀?"), (1, 3, "assistant", "yes"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "other"), (2, 2, "user", "other"),
    (3, 0, "user", "hi"), (4, 0, None, "alone"), (4, 1, "assistant", None), (4, None, "system", "rules"), (None, 0, "user", "hi"),
    (5, 0, "assistant", "same"), (5, 1, "assistant", "same"),
]


def test_prefix_completions_and_masks(spark):
    turns = edge.with_clashing(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    convs = preference.conversations(turns)
    pairs = preference.reference_pairs(convs)
    assert sorted(tuple(p) for p in pairs.collect()) == [(1, 2), (1, 3)]
    rows = {r.rejected_id: r for r in preference.format_pairs(preference.paired_turns(convs, pairs)).collect()}
    two = rows[2]
    assert two.n_prompt == 2 and two.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    start, end = map(int, two.chosen_mask.split(":"))
    assert two.chosen[start:end] == "yes<|end|>\n" and two.rejected_mask == ""
    assert rows[3].n_prompt == 1 and rows[3].rejected == "" and rows[3].chosen.startswith("<|assistant|>")
    swapped = preference.swapped_replies(convs).collect()
    assert [r.chosen_id for r in swapped] == [1]
    row = preference.format_pairs(preference.swapped_replies(convs)).first()
    assert row.n_prompt == 3 and row.chosen == "<|assistant|>\nyes<|end|>\n" and row.rejected == "<|assistant|>\nhello<|end|>\n"


def test_null_turns_come_first(spark):
    convs = preference.conversations(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    four = convs.filter("conv = 4").first().turns
    assert [(t.role, t.text) for t in four] == [("system", "rules"), ("user", "alone"), ("assistant", "")]


def test_repeated_last_replies_still_give_a_pair(spark):
    replies = {1: "ABB", 2: "AABBB", 3: "BBB", 4: "ABA", 5: "A"}
    turns = [(c, i, "assistant", t) for c, texts in replies.items() for i, t in enumerate(texts)]
    convs = preference.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    pairs = {r.chosen_id: ("".join(t.text for t in r.c), "".join(t.text for t in r.r)) for r in preference.swapped_replies(convs).collect()}
    assert pairs == {1: ("ABB", "ABA"), 2: ("AABBB", "AABBA"), 4: ("ABA", "ABB")}


def test_query_against_sql(spark):
    assert differences(spark, engine(), queries.op8_preference_formatting, queries.oracles()["op8_preference_formatting"], SF_DIR) == []


def test_empty(spark):
    convs = preference.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert preference.format_pairs(preference.paired_turns(convs, preference.reference_pairs(convs))).collect() == []
