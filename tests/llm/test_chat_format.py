"""Formatting and reading back, texts and attachments."""

import hashlib

from pyspark.sql import functions as F

from lithic.llm import chat_format as C
from lithic.llm.queries import op5_chat_format

TEXTS = ["plain", "<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<", "<|", "<\\|", "|>\n<|im_sep|>", "", None, "é😀" * 500, "x" * 100_000 + "<", "\\<|\\"]


def test_awkward_texts_come_back(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", "system", "we\\ird<|role", None][(c + t) % 5], TEXTS[(c * 7 + t) % len(TEXTS)]) for c in range(6) for t in range(13)]
    rows += [(None, 0, "assistant", "lost"), (9, None, "assistant", "b"), (9, None, "assistant", "a"), (9, 1, "user", "u"), (9, 1, "user", "u")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "'x' AS body").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op5_chat_format(spark, str(tmp_path)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    by[-1] = [(0, "user", said), (1, "assistant", said)]
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_attachments(spark):
    parts = "array(named_struct('type','text','text','see <|','ref',null,'units',0), named_struct('type','image','text',null,'ref','a.png','units',2), named_struct('type','odd','text','o','ref',null,'units',0), named_struct('type','audio','text',null,'ref','b.wav','units',null))"
    turns = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, {parts} AS parts UNION ALL SELECT 1L, 1L, 'assistant', array(named_struct('type','text','text','ok','ref',null,'units',0)) UNION ALL SELECT 1L, 2L, 'user', null")
    row = C.read_back(C.format_conversations(turns.withColumn("parts", F.col("parts").cast(C.PARTS)))).first()
    assert row.formatted == "<|im_start|>user<|im_sep|>see <\\|<|image:512|>o<|audio:25|><|im_end|>\n<|im_start|>assistant<|im_sep|>ok<|im_end|>\n<|im_start|>user<|im_sep|><|im_end|>\n"
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, 1, "image", "a.png", 512), (0, 3, "audio", "b.wav", 25)]
    assert row.loss_text == "ok"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in op5_chat_format(spark, str(tmp_path)).collect()] == [-1]
