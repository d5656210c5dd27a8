import random

import pytest

from reviewloom.operators import conversations
from reviewloom.schemas import MESSAGES


def loop(messages):
    """Pair the messages of one conversation one at a time."""
    pairs = []
    for role, text in messages:
        if role == "user":
            pairs.append([text, ""])
        elif role == "assistant":
            if pairs and pairs[-1][1] == "":
                pairs[-1][1] = text
            else:
                pairs.append(["", text])
    return pairs


def table(spark, conversations_):
    rows = [(c, t, role, text) for c, messages in conversations_.items() for t, (role, text) in enumerate(messages)]
    return spark.createDataFrame(rows, MESSAGES)


def collected(pairs):
    out = {}
    for r in pairs.orderBy("conv_id", "pair_no").collect():
        out.setdefault(r.conv_id, []).append([r.user, r.assistant])
    return out


ROLES = {"u": "user", "a": "assistant", "s": "system"}


def named(sequence):
    return [(ROLES[c], f"{c}{i}") for i, c in enumerate(sequence)]


FIXED = ["ua", "uau", "uaa", "aa", "uu", "sua", "s", "usa", "asuas", "uauauauauauauaua"]


def test_fixed_sequences(spark):
    given = {i: named(s) for i, s in enumerate(FIXED)}
    given[50] = [("assistant", ""), ("assistant", "late")]
    given[51] = [("user", "q"), ("assistant", ""), ("assistant", "filled"), ("assistant", "new")]
    given[52] = [("user", ""), ("user", "")]
    expected = {c: p for c, m in given.items() if (p := loop(m))}
    assert collected(conversations.pair_turns(table(spark, given))) == expected


@pytest.mark.parametrize("width", [1, 2, 3, 4096])
def test_ranges_do_not_change_the_pairs(spark, width):
    rnd = random.Random(width)
    given = {c: [(rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["", "x", "y"]))
                 for _ in range(rnd.randint(1, 40))] for c in range(40)}
    expected = {c: p for c, m in given.items() if (p := loop(m))}
    assert collected(conversations.pair_turns(table(spark, given), width)) == expected


def test_sparse_turn_numbers(spark):
    rows = [(1, 10, "user", "a"), (1, 90000, "assistant", "b"), (1, 500000, "assistant", "c")]
    assert collected(conversations.pair_turns(spark.createDataFrame(rows, MESSAGES))) == {1: [["a", "b"], ["", "c"]]}


def test_last_turns_and_history(spark):
    pairs = conversations.pair_turns(table(spark, {1: named("ua" * 7), 2: named("ua")}))
    assert collected(conversations.last_turns(pairs, 5)) == {1: [[f"u{i}", f"a{i + 1}"] for i in range(4, 14, 2)], 2: [["u0", "a1"]]}
    lists = {r.conv_id: [tuple(p) for p in r.conversation_history] for r in conversations.history(pairs, 2).collect()}
    assert lists == {1: [("u10", "a11"), ("u12", "a13")], 2: [("u0", "a1")]}


def test_last_user_message(spark):
    given = {1: [("user", "first"), ("assistant", "x"), ("user", "")], 2: [("assistant", "x")], 3: [("user", "only")]}
    inputs = spark.createDataFrame([(2, "typed"), (4, None)], "conv_id long, user_input string")
    got = {r.conv_id: r.last_user_message for r in conversations.last_user_message(table(spark, given), inputs).collect()}
    assert got == {1: "first", 2: "typed", 3: "only", 4: ""}
    alone = conversations.last_user_message(table(spark, given)).collect()
    assert {r.conv_id: r.last_user_message for r in alone} == {1: "first", 2: "", 3: "only"}


def test_answers_are_appended(spark):
    pairs = conversations.pair_turns(table(spark, {1: named("uaua")}))
    answers = spark.createDataFrame([(1, "q", "r"), (9, "new", "r")], "conv_id long, user string, assistant string")
    assert collected(conversations.append_answers(pairs, answers)) == {
        1: [["u0", "a1"], ["u2", "a3"], ["q", "r"]], 9: [["new", "r"]]}
