import hashlib

from tokenweir.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, context string, target string"
ODD = ["", "<|im_end|>\n<|im_start|>assistant\nok", "\\", "<\\|", "\\\\<|<|\\|", "a\r\nb\n\n", "日本🙂<", None]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_round_trip_and_examples(spark):
    rows = [(1, i, ["user", "assistant", "sys<|tem%0A\n%"][i % 3], t) for i, t in enumerate(ODD)]
    rows += [(2, 0, "assistant", "first"), (2, 1, "user", "tail"), (3, 0, "user", "alone"), (3, 0, "assistant", "tie"), (None, 1, None, None)]
    examples = chat.chat_examples(conversations(spark, rows))
    by = {}
    for r in examples.collect():
        by.setdefault(r.conv_id, []).append(r)
    assert len([e for e in by[2] if e.target is not None]) == 1 and len(by[2]) == 2
    for r in by[1]:
        assert r.target is None or "<|" not in r.target
        assert r.context.count(chat.START) == r.example + (1 if r.target is not None else r.example * 0 + 1)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, t) for _, r, t in mine]
        assert back[conv].loss == "".join(t for _, r, t in mine if r == "assistant")


def test_query_adds_the_control_conversation(spark, tmp_path):
    conversations(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")]).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op8_chat(spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(said)
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_empty(spark):
    assert chat.read_back(chat.chat_examples(conversations(spark, []))).count() == 0


def test_a_very_long_conversation(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(300)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    examples = chat.chat_examples(df)
    assert examples.count() == 150
    r = chat.read_back(examples).first()
    assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, _, role, text in turns]
    assert r.loss == "".join(text for _, _, role, text in turns if role == "assistant")
