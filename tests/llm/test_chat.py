import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerkeep.llm import chat


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\\ln<>/s\n[]I", max_size=12), st.text(alphabet="ab\\ln<>/s\n[]I", max_size=20)), max_size=5))
def test_turns_round_trip(turns):
    assert chat.read_turns("".join(chat.write_turn(r, t) for r, t in turns)) == turns


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", "more\\l"), (1, 3, "assistant", "yes"),
    (2, 1, "assistant", None), (2, 0, "system", "<s>user\nfake</s>"), (2, 2, "user", "left over"),
    (3, 0, "user", "no reply"), (4, None, None, None), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"),
    (None, 0, "user", "nobody"), (None, 1, "assistant", "x" * 100_000), (6, 0, "assistant", ""),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, last int")


def test_read_back_equals_the_turns(spark):
    groups = {}
    for r in sorted(ROWS, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in chat.read_back(chat.expand(table(spark).repartition(3))).collect()}
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        r, replies = got[conv], [t for role, t in turns if role == "assistant"]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == sum(map(len, replies))
        assert r.loss_sha256 == hashlib.sha256("".join(replies).encode()).hexdigest()


def test_each_example_trains_one_reply_after_its_whole_context(spark):
    rows = sorted((r for r in chat.expand(table(spark)).collect() if r.conv_id == 1), key=lambda r: r.example)
    assert [chat.read_turns(r.formatted) for r in rows] == [[("user", "hi"), ("assistant", "</s>[INST] ok [/INST]")], [(a, b) for c, _, a, b in ROWS if c == 1]]
    assert [chat.unescape(r.formatted[r.loss_begin : r.loss_end]) for r in rows] == ["</s>[INST] ok [/INST]", "yes"]
    assert [r.last for r in rows] == [False, True] and all(r.target for r in rows)
    rest = [r for r in chat.expand(table(spark)).collect() if r.conv_id in (2, 3) and not r.target]
    assert sorted((r.conv_id, r.n_turns, r.loss_end - r.loss_begin, r.last) for r in rest) == [(2, 3, 0, True), (3, 1, 0, True)]


def test_empty_table(spark):
    assert chat.read_back(chat.expand(table(spark).where(F.lit(False)))).collect() == []
