"""Chat formatting: exact round trip and loss mask."""

import hashlib
import random

from pyspark.sql import functions as F

from swayline.llm.chat_format import PART, format_chats, masked_text, op2_chat_format, read_parts, read_turns, text_parts

PIECES = ["\\", "<", ">", "</turn>\n", "<turn>", "\\l", "\\b", "\\n", "\n", "é", "😀", "<image:0>", "ok ", ""]


def test_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "odd\nrole<", None]), rng.choice([None, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))])))
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = format_chats(docs.withColumn("parts", text_parts(F.col("text")))).withColumn("turns", read_turns(F.col("formatted")))
    out = out.withColumn("texts", F.transform("turns", lambda t: F.array_join(read_parts(t["body"])["text"], ""))).withColumn("learned", masked_text(F.col("turns"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        r = got[conv]
        assert [t.role for t in r.turns] == [m[2] or "" for m in mine]
        assert r.texts == [m[3] or "" for m in mine]
        assert r.learned == "".join(m[3] or "" for m in mine if m[2] == "assistant")
        assert r.n_turns == len(mine)
        for s in r.loss_spans:
            begin = r.turn_starts[s.turn]
            assert r.formatted[begin + s.start : begin + s.end] == r.turns[s.turn].piece[s.start : s.end]


def test_typed_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("w"), x.get("h"), x.get("s"), x.get("p"))
    rows = [
        (1, 0, "user", [part("text", text="look <"), part("image", ref="a.png", w=30, h=14), part("text", text="and"), part("document", ref="b.pdf", p=2)]),
        (1, 1, "assistant", [part("text", text="a"), part("audio", ref="c.wav", s=1.01), part("text", text="b"), part("odd", ref="d")]),
        (1, 2, "user", None),
    ]
    r = format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")).withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", masked_text(F.col("turns"), F.col("loss_spans"))).withColumn("parts", F.transform("turns", lambda t: read_parts(t["body"]))).first()
    assert r.formatted == "<turn>user\nlook \\l<image:0>and<document:1></turn>\n<turn>assistant\na<audio:2>b<odd:3></turn>\n<turn>user\n</turn>\n"
    assert [(a.number, a.type, a.ref, a.turn, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 0, 3), (1, "document", "b.pdf", 0, 2048), (2, "audio", "c.wav", 1, 26), (3, "odd", "d", 1, 0)]
    assert r.expanded_tokens == 3 + 2048 + 26 and r.learned == "ab"
    assert [[(p.type, p.text, p.number) for p in x] for x in r.parts][0] == [("text", "look <", None), ("image", None, 0), ("text", "and", None), ("document", None, 1)]


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{PART}>")).count() == 0


def test_query_on_a_table(spark, tmp_path):
    rows = [(1, 1, "assistant", "b<"), (1, 0, "user", None), (2, 0, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op2_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    probe = "\\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == digest(f"user\n{probe}\nassistant\n{probe}\n")
    assert got[-7].loss_sha256 == digest(probe) and got[-7].loss_chars == len(probe)
    assert got[1].turns_sha256 == digest("user\n\nassistant\nb<\n") and got[1].loss_sha256 == digest("b<")
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
