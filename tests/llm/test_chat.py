"""Formatting reads back to exactly what went in."""

from __future__ import annotations

import hashlib
import random

from docledger.llm import chat

PARTS = ["<|im_end|>", "<|im_start|>", "<|im_next|>", "<|", "\\", "\\\\", "<\\|", "|>", "\n", "é",
         "assistant", " ok", "<", "|", "<|im_line|>", "\U0001f600", "user\n"]


def test_round_trip(spark):
    r = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(r.randint(1, 6)):
            text = r.choice([None, "", "".join(r.choices(PARTS, k=r.randint(1, 8)))])
            role = r.choice(["user", "assistant", "assistant", None, "tool\nx", "<|im_end|>\\"])
            rows.append((conv, turn // 2, role, text, "extra"))
            if r.random() < 0.1:
                rows.append(rows[-1])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    out = chat.formatted(frame.repartition(4))
    assert out.where("formatted <> array_join(transform(segments, s -> s.text), '')").count() == 0
    got = {x["conv_id"]: x for x in chat.digest(chat.read_back(out)).collect()}
    assert len(got) == 60
    for conv in range(60):
        turns = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv)
        said = "".join(text for _, role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(said)
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_one_role_in_a_row_is_one_message(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert out.first()["formatted"] == (
        "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n")
    assert chat.formatted(out.sparkSession.createDataFrame(
        [], "conv_id long, turn long, role string, text string")).collect() == []


def test_null_turns_and_ids_form_a_conversation(spark):
    rows = [(None, None, "user", "a"), (None, 1, "assistant", "b"), (None, None, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.read_back(chat.formatted(frame))).first()
    assert (got["conv_id"], got["n_turns"], got["loss_chars"]) == (None, 3, 1)
