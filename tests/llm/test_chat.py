import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpus_guard.llm import chat

TURN = "conv_id long, turn long, role string, text string"
PIECES = st.sampled_from(["### ", ": ", "<also>", "</turn>\n", "\\", "\\b", "#", "<", "assistant", "é😀", " ", "user", "\n"])
TEXT = st.none() | st.lists(PIECES, max_size=6).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system"]) | TEXT


def _want(rows):
    """Turns in order, and the texts of the assistant."""
    rows = sorted((t is not None, t or 0, r or "", x or "") for t, r, x in rows)
    return [(r, x) for _, _, r, x in rows], "".join(x for _, _, r, x in rows if r == "assistant")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.none() | st.integers(0, 3), ROLE, TEXT), min_size=1, max_size=7), max_size=6))
def test_round_trip(spark, conversations):
    rows = [(i, *turn) for i, turns in enumerate(conversations) for turn in turns]
    got = chat.read_back(chat.formatted(spark.createDataFrame(rows, TURN))).collect()
    assert len(got) == len(conversations)
    for r in got:
        turns, learnt = _want(conversations[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == turns and r.loss_text == learnt


def test_template(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "a < b"), (1, 2, "user", "#2"), (1, 3, "assistant", "ok")]
    row = chat.formatted(spark.createDataFrame(rows, TURN)).first()
    assert row.formatted == "### system: be kind</turn>\n### user: a \\l b<also>\\h2</turn>\n### assistant: ok</turn>\n"
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss] == ["ok"]


def test_long_and_clashing(spark):
    rows = [(None, i, ("user", "assistant")[i % 2], "x" * i, "t") for i in range(2000)]
    frame = spark.createDataFrame(rows, TURN + ", turns string").withColumnRenamed("turns", "blocks")
    row = chat.read_back(chat.formatted(frame)).first()
    assert len(row.turns) == 2000 and len(row.loss_text) == sum(range(1, 2000, 2))
    assert chat.formatted(frame.where("false")).collect() == []


def test_probe(spark, tmp_path):
    spark.createDataFrame([(3, 0, "assistant", None)], TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op7(spark, str(tmp_path)).collect()}
    assert set(got) == {3, -7} and got[3].loss_chars == 0 and got[3].n_turns == 1
    probe = got[-7]
    assert probe.loss_chars == len(chat.PROBE)
    assert probe.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()
    turns = f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"
    assert probe.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
