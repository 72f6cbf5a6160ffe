import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from marketframe.llm import chat

MARKS = ["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "user", "assistant", "\n", "é", "<\\/s>", "<\\\\|im_end|>", "\\n", "s>", "im_end|>\n"]
TEXT = st.lists(st.sampled_from(MARKS), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    made, spans = chat.render(turns)
    assert chat.parse(made) == turns
    assert [chat.unescape(made[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]
    assert made.count("<|im_start|>") == made.count("<|im_end|>") == len(turns)


def test_no_control_string_is_left():
    said = chat.escape("</s>[INST] ok [/INST]<|im_end|><\\/s>")
    assert said == "<\\/s>[\\INST] ok [\\/INST]<\\|im_end|><\\\\/s>"


RECORDS = {
    "turns": ({"turns": [{"turn": 2, "role": "assistant", "text": "B"}, {"turn": 1, "role": "user", "text": "A"}]}, [("user", "A"), ("assistant", "B")]),
    "messages": ({"messages": [{"role": "user", "content": "A"}, {"role": "assistant", "content": None}]}, [("user", "A"), ("assistant", "")]),
    "shared": ({"conversations": [{"from": "human", "value": "A"}, {"from": "gpt", "value": "B"}]}, [("user", "A"), ("assistant", "B")]),
    "completion": ({"prompt": "A", "completion": "B"}, [("user", "A"), ("assistant", "B")]),
    "response": ({"response": "B", "prompt": "A"}, [("user", "A"), ("assistant", "B")]),
    "question": ({"question": "A", "answer": "B"}, [("user", "A"), ("assistant", "B")]),
    "instruction": ({"instruction": "A", "output": "B"}, [("user", "A"), ("assistant", "B")]),
    "instruction_input": ({"instruction": "A", "input": "X", "output": "B"}, [("user", "A\n\nX"), ("assistant", "B")]),
    "system_prompt": ({"system": "S", "prompt": "A", "response": "B"}, [("system", "S"), ("user", "A"), ("assistant", "B")]),
}


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS.values())]
    rows += [(50, json.dumps({"messages": []})), (51, json.dumps({"who": 1})), (52, None), (0, rows[0][1])]
    got = chat.format_chats(spark.createDataFrame(rows, "id int, record string"), "record").collect()
    by = {r.id: r for r in got}
    for i, (name, (_, turns)) in enumerate(RECORDS.items()):
        assert by[i].layout == name and chat.parse(by[i].formatted) == turns
    assert (by[50].layout, by[50].formatted) == ("messages", "") and by[51].layout is None and by[52].formatted == ""
    assert len(got) == len(rows)


def test_turn_tables(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(7, 1, "assistant", "B ü"), (7, 0, "user", "A"), (8, 0, "user", None), (9, 0, "tool\nx", "t"), (9, 0, "assistant", None), (None, 0, "assistant", "n"), (-1, 0, "user", said), (-1, 1, "assistant", said)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.records_of_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[7][1:5] == (2, sha("user\nA\nassistant\nB ü\n"), 3, sha("B ü"))
    assert got[8][1:5] == (1, sha("user\n\n"), 0, sha(""))
    assert got[9][1:5] == (2, sha("assistant\n\ntool\nx\nt\n"), 0, sha(""))
    assert got[-1][1:5] == (2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))
    assert got[None].loss_chars == 1
    assert chat.format_chats(chat.records_of_turns(df.limit(0))).count() == 0


def test_odd_records(spark):
    deep = "[" * 100_000 + "]" * 100_000
    records = [
        "{bad", "[1, 2]", '"text"', "7", deep, '{"turns": ["a", "b"]}', '{"turns": [null]}', '{"turns": 5}',
        '{"messages": [{"role": "user", "content": 5}, {"role": 7, "content": true}]}',
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}',
        '{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}]}]}',
        '{"messages": [{"role": "user", "content": "\\ud800 half"}]}',
        '{"turns": [{"turn": "b", "role": "user", "text": "2"}, {"turn": 1, "role": "user", "text": "1"}, {"turn": null, "role": "user", "text": "0"}]}',
        '{"prompt": 3, "completion": null}',
    ]
    got = chat.format_chats(spark.createDataFrame(list(enumerate(records)), "id int, record string")).orderBy("id").collect()
    assert [r.layout for r in got[:8]] == [None] * 8 and all(r.formatted == "" for r in got[:8])
    assert [chat.parse(r.formatted) for r in got[8:]] == [
        [("user", "5"), ("7", "true")], [("user", "a\nb")], [("user", "x"), ("assistant", "b")], [("user", "\ufffd half")],
        [("user", "0"), ("user", "1"), ("user", "2")], [("user", "3"), ("assistant", "")],
    ]


def test_mixed_layouts_of_turn_tables(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "A"), (1, 1, "assistant", said), (2, 1, "assistant", "B"), (2, 0, "user", "A"), (2, 2, "user", ""), (3, 0, "system", "S"), (3, 1, "user", "A"), (4, 0, "user", None), (4, 1, "assistant", "x"), (5, 0, None, "t"), (6, 0, "assistant", "a"), (6, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    plain = {r.conv_id: r for r in chat.format_chats(chat.records_of_turns(df)).collect()}
    mixed = {r.conv_id: r for r in chat.format_chats(chat.records_of_turns(df, mixed=True)).collect()}
    assert {k: (r.formatted, r.loss_spans) for k, r in mixed.items()} == {k: (r.formatted, r.loss_spans) for k, r in plain.items()}
    assert {k: r.layout for k, r in mixed.items()} == {1: "completion", 2: "shared", 3: "turns", 4: "shared", 5: "turns", 6: "shared"}


def test_clashing_names_and_empty_lists(spark):
    records = [
        '{"messages": [{"role": "user", "content": []}, {"role": "assistant", "content": "x"}]}',
        '{"messages": [{"role": "user", "content": []}, {"role": "assistant", "content": [{"type": "text", "text": "y"}]}]}',
        '{"messages": [{"role": "user", "content": []}]}', '{"prompt": [], "completion": "z"}', '{"messages": []}', '{"who": []}',
    ]
    df = spark.createDataFrame([(i, r, "a", 1.5, "c", "d") for i, r in enumerate(records)], "id int, record string, layout string, formatted double, loss_spans string, Layout2 string")
    got = chat.format_chats(df).orderBy("id").collect()
    assert [(r.layout, chat.parse(r.formatted)) for r in got] == [
        ("messages", [("user", ""), ("assistant", "x")]), ("message_parts", [("user", ""), ("assistant", "y")]), ("messages", [("user", "")]),
        ("completion", [("user", ""), ("assistant", "z")]), ("messages", []), (None, []),
    ]
    assert got[0].Layout2 == "d"
    one = chat.format_chats(spark.createDataFrame([(records[0],)], "layout string"), "layout").collect()
    assert one[0].layout == "messages" and len(one[0]) == 3
    assert chat.format_chats(df.limit(0)).collect() == []
