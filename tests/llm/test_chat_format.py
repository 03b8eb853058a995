"""op4: exact round trips, layouts and odd rows."""

import pytest

from ocellus.llm import chat_format as C

ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<s>", "<<SYS>> x <</SYS>>", " lead and trail ", "", "a\nb\r\n", "[ROLE] y [/ROLE] ", "<\\s>", "🙂 </s> 🙂", "[[INST]INST]", "<<s>s>", "$1 \\$2"]


def read(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r.conv_id: r for r in C.read_back(C.format_chats(C.table_turns(frame))).collect()}


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool [/ROLE] x", "", "</s>"])
def test_round_trip(spark, role):
    rows = [(i, 0, role, t) for i, t in enumerate(ODD)] + [(100, i, role, t) for i, t in enumerate(ODD)]
    got = read(spark, rows)
    for i, t in enumerate(ODD):
        assert [tuple(x) for x in got[i].turns] == [(role, t)]
    assert [tuple(x) for x in got[100].turns] == [(role, t) for t in ODD]
    assert got[100].loss_texts == (ODD if role == "assistant" else [])


def test_control_strings_mark_turns_only(spark):
    got = read(spark, [(1, 0, "user", ODD[0]), (1, 1, "assistant", ODD[0])])[1]
    assert got.formatted.count("[INST] ") == 1 and got.formatted.count("</s>") == 1


def test_nulls_ties_and_repeats(spark):
    got = read(spark, [(None, None, None, None), (1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "z")])
    assert [tuple(x) for x in got[1].turns] == [("assistant", "z"), ("user", ""), ("user", "b"), ("user", "b")]
    assert [tuple(x) for x in got[None].turns] == [("", "")]


def test_extra_and_missing_columns(spark):
    frame = spark.sql("SELECT 1L conv_id, 0L turn, 'user' role, 'x' text, 'y' formatted, 3 AS part, array(1) AS spans")
    assert C.read_back(C.format_chats(C.table_turns(frame))).first().turns[0].text == "x"
    with pytest.raises(ValueError):
        C.table_turns(frame.drop("role"))
    assert C.format_chats(C.table_turns(frame.limit(0))).count() == 0


RECORDS = [
    (1, '{"messages":[{"role":"human","content":"q"},{"role":"assistant","content":"a"}],"id":7}', [("user", "q"), ("assistant", "a")]),
    (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":null}],"system":"s"}', [("system", "s"), ("user", "q"), ("assistant", "")]),
    (3, '{"instruction":"do","input":"it","output":"done"}', [("user", "do\n\nit"), ("assistant", "done")]),
    (4, '{"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
    (5, '{"prompt":"p","completion":"c","system":"s"}', [("system", "s"), ("user", "p"), ("assistant", "c")]),
    (6, '{"question":"q","answer":"a","context":"c"}', [("user", "c\n\nq"), ("assistant", "a")]),
    (7, '{"prompt":"p"}', []),
    (8, "no json", []),
    (9, None, []),
]


def test_record_layouts(spark):
    frame = spark.createDataFrame([(i, r) for i, r, _ in RECORDS], "conv_id long, record string")
    turns = C.record_turns(frame, "conv_id", "record").collect()
    for i, _, want in RECORDS:
        assert [(t.role, t.text) for t in sorted((t for t in turns if t.conv_id == i), key=lambda t: t.turn)] == want, i


def test_fingerprints_are_distinct():
    names = C.registry(C.RECORDS)
    assert len(names) == sum(2 ** len(x.optional) for x in C.RECORDS)


MIXED = [
    (1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"prompt":"q"}', [("user", "q"), ("assistant", "a")]),
    (2, '{"messages":[{"role":"user","content":null},{"role":"assistant"}]}', [("user", ""), ("assistant", "")]),
    (3, '{"prompt":"p","response":"r","context":"c"}', [("user", "c\n\np"), ("assistant", "r")]),
    (4, '{"instruction":"do","context":"c","response":"r"}', [("user", "c\n\ndo"), ("assistant", "r")]),
    (5, '{"prompt":"p","completion":"c","answer":"z"}', [("user", "p"), ("assistant", "c")]),
    (6, '{"instruction":"do","output":"o","response":"r"}', [("user", "do"), ("assistant", "o")]),
]


def test_fields_of_other_layouts(spark):
    frame = spark.createDataFrame([(i, r) for i, r, _ in MIXED], "conv_id long, record string")
    turns = C.record_turns(frame, "conv_id", "record").collect()
    for i, _, want in MIXED:
        assert [(t.role, t.text) for t in sorted((t for t in turns if t.conv_id == i), key=lambda t: t.turn)] == want, i
    assert C.unmatched_records(frame, "conv_id", "record").count() == 0


def test_unmatched_records(spark):
    frame = spark.createDataFrame([(i, r) for i, r, _ in RECORDS], "conv_id long, record string")
    got = sorted((r.conv_id, r.record) for r in C.unmatched_records(frame, "conv_id", "record").collect() if r.record is not None)
    assert got == [(7, '{"prompt":"p"}'), (8, "no json")]
    assert C.unmatched_records(frame, "conv_id", "record").where("record IS NULL").count() == 1


def test_long_texts_and_conversations(spark):
    text = "</s>[INST] ok \\ " * 60_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text)] + [(2, i, "user" if i % 2 == 0 else "assistant", f"<s>{i}") for i in range(4_000)]
    got = read(spark, rows)
    assert [tuple(x) for x in got[1].turns] == [("user", text), ("assistant", text)]
    assert got[1].loss_texts == [text]
    assert [x.text for x in got[2].turns] == [f"<s>{i}" for i in range(4_000)]
    assert got[2].loss_texts == [f"<s>{i}" for i in range(1, 4_000, 2)]
