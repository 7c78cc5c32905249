import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import chat

PARTS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "[", "<", "/", "]", " ", "ok", "é", "\n", "INST]", "s>"])
TEXT = st.lists(PARTS, max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]", "\\"]), TEXT), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    text, segments = chat.format_conversation(turns)
    formatter = chat.Formatter(chat.Template())
    assert list(formatter.read(text)) == turns
    assert "".join(s for s, _ in segments) == text
    assert [formatter.unescape(s) for s, loss in segments if loss] == [t for r, t in turns if r == "assistant"]


def test_order_is_judged():
    def error(roles):
        c = chat.Conversation(chat.Formatter(chat.Template()), 1)
        for r in roles:
            c.add(r, "x")
        return c.row()[-1]

    assert error(["system", "user", "assistant"]) is None and error(["user", "assistant", "user", "assistant"]) is None
    assert error(["user", "user", "assistant"]) == "turn 1: user after user"
    assert error(["user"]) == "ends with user" and error(["user", "system"]).startswith("turn 1")
    assert error(["tool"]).startswith("turn 0")


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        formatted = chat.format_conversation([(r, t) for _, _, r, t in turns])[0]
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted))
    return out


def test_table_matches_brute_force(spark, sf_dir):
    edge = [(9001, None, "user", "a"), (9001, 0, None, None), (9001, 0, "assistant", "[/INST] \\ </s>"), (9001, 0, "assistant", "[/INST] \\ </s>"), (None, 1, "user", "x"), (None, 1, "assistant", "y" * 300_000), (9002, 3, "tool", "")]
    edge += [(9003, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(3000)]
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").unionByName(spark.createDataFrame(edge, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: tuple(r)[1:6] for r in chat.format_digests(df.withColumn("loss", chat.F.lit(1)).withColumn("n_turns", chat.F.lit(1))).collect()}
    assert got == brute([tuple(r) for r in df.collect()])


def test_segments_and_empty(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = chat.format_segments(df).collect()
    assert len(rows) == 3 * df.count() and sum(r.loss for r in rows) == df.filter("role = 'assistant'").count()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_digests(empty).collect() == [] and chat.format_segments(empty).collect() == []
