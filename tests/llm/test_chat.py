from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from starledger.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def collapse(rows):
    """conv_id -> (turns, copies) of the conversations to keep, by comparing all with all."""
    logged = {}
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            logged.setdefault(conv, set()).add((-1 if turn is None else turn, role or "unknown", text or ""))
    steps = {}
    for conv, turns in logged.items():
        steps[conv] = [tuple(sorted(t for t in turns if t[0] == n)) for n in sorted({t[0] for t in turns})]
    out = {}
    for conv, mine in steps.items():
        if any(len(other) > len(mine) and other[: len(mine)] == mine for other in steps.values()):
            continue
        same = [c for c, other in steps.items() if other == mine]
        if conv == min(same):
            out[conv] = (sum(map(len, mine)), len(same))
    return out


turn = st.tuples(st.sampled_from([0, 1, 2, 3, 600, None]), st.sampled_from(["user", "assistant", None]), st.sampled_from(["a", "b", "", None]))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(turn, min_size=1, max_size=4), min_size=1, max_size=12))
def test_collapse_equals_brute_force(spark, conversations):
    rows = [(i, *t, "x") for i, turns in enumerate(conversations) for t in turns] + [(None, 0, "user", "a", "x")]
    got = chat.maximal(chat.turns_of(spark.createDataFrame(rows, SCHEMA)))
    assert {r["conv_id"]: (r["turns"], r["copies"]) for r in got.collect()} == collapse(rows)


def test_snapshots_copies_and_rendering(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}", "x") for c in range(1, 6) for t in range(c)]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", f"turn {t}", "x") for t in range(5)]  # a copy of 5
    rows += [(7, 0, "user", "turn 0", "x"), (7, 1, "assistant", "another answer", "x"), (7, 1, "assistant", "another answer", "x")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(out) == [5, 7] and out[5]["copies"] == 2 and out[5]["turns"] == 5 and out[7]["turns"] == 2
    assert out[7]["text"] == "<|user|>\nturn 0\n<|end|>\n<|assistant|>\nanother answer\n<|end|>\n"


def test_a_conversation_with_very_many_turns_is_cut_into_parts(spark):
    rows = spark.range(5000).selectExpr("cast(1 as bigint) as conv_id", "id as turn", "'user' as role", "repeat('x', 50) as text", "'p' as part")
    prefix = rows.where("turn < 3000").selectExpr("cast(2 as bigint) as conv_id", "turn", "role", "text", "part")
    out = chat.format_conversations(rows.union(prefix)).collect()
    assert {r["conv_id"] for r in out} == {1} and sorted(r["part"] for r in out) == list(range(20))
    assert sum(r["turns"] for r in out) == 5000


def test_no_rows(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
