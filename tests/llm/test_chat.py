import hashlib
import re

from pyspark.sql import functions as F

from pagelake.llm import chat

NASTY = ["\\### Assistant: </turn> ok", "<|end|>", "\\<|user|>\\", "<", "|>", "a<|>b", "<\\|", "\\\\|>", "", None, "<|end|", "日本 👍"]


def test_round_trip(spark):
    rows = []
    for c in range(len(NASTY)):
        for t in range(len(NASTY)):
            rows.append((c, t, ["user", "assistant", "<|x|>\\", None][(c + t) % 4], NASTY[(c * 5 + t) % len(NASTY)], "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    formatted = {r["conv_id"]: r for r in made.collect()}
    for c in range(len(NASTY)):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["loss_text"] == "".join(t for r, t in want if r == "assistant")
        f = formatted[c]
        assert got[c]["formatted_chars"] == len(f["formatted"].encode("utf-16-le").decode("utf-16-le"))
        assert len(f["loss_spans"]) == sum(r == "assistant" for r, _ in want)
        assert f["attachments"] == []


def test_typed_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,size:long>>"
    rows = [
        (1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 3), ("text", None, None, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", 2), (None, "done", None, None)]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}")
    got = {r["conv_id"]: r for r in chat.format_chats(df, "parts").collect()}
    assert got[1]["formatted"] == "<|user|>see [image 1][audio 2]<|end|><|assistant|>[document 1]done<|end|>"
    assert [(a["n"], a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(1, "image", "a.png", 576), (2, "audio", "b.wav", 75), (1, "document", "c.pdf", 2048)]
    assert got[1]["tokens"] == 4 + 576 + 75 + 2048 + 4
    assert got[2]["formatted"] == "<|user|><|end|>"


def test_roles_and_texts_that_look_like_marks(spark):
    roles = ["end", ">x", "end|", "|", "<", "", "\\end", "assistant", ">"]
    texts = ["hello", ">hi", "a [image 1] b", "\\[image 1]", "[audio 2][document 3]", "|>", "<|end|>x"]
    rows = [(0, k, r, texts[k % len(texts)]) for k, r in enumerate(roles * 7)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.read_chats(made).first()
    assert [tuple(t) for t in got["turns"]] == [r[2:] for r in rows]
    assert got["loss_text"] == "".join(t for _, _, r, t in rows if r == "assistant")
    assert not [m for m in re.findall(r"(?<!\\)\[(?:image|audio|document) ", made.first()["formatted"])]


def test_texts_side_by_side_make_no_marks(spark):
    part = "array<struct<type:string,text:string,ref:string,size:long>>"
    texts = ["a<", "|end|>", "[", "image 1]", "[im", "age 2]", "", "x", "\\", ">y|", ">"]
    parts = [("text", t, None, None) for t in texts] + [("image", None, "i.png", None), ("text", ">z", None, None)]
    made = chat.format_chats(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {part}"), "parts")
    assert chat.read_chats(made).first()["turns"][0]["text"] == "".join(texts) + "[image 1]>z"
    assert re.findall(r"(?<!\\)\[image \d+\]", made.first()["formatted"]) == ["[image 1]"]


def test_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], schema))).count() == 0
    rows = [(None, None, None, None), (5, 1, "b", "2"), (5, 1, "b", "2"), (5, 1, "a", "1"), (5, None, "z", "0"), (6, 0, "assistant", "x" * 500_000)]
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert [t["text"] for t in got[5]["turns"]] == ["0", "1", "2", "2"]
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")]
    assert len(got[6]["loss_text"]) == 500_000


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    plan = chat.read_chats(chat.format_chats(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert chat.format_chats(df).select(F.sha2("formatted", 256)).first()[0] == hashlib.sha256(b"<|user|>hi<|end|>").hexdigest()
