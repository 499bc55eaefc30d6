from __future__ import annotations

import hashlib

import pytest
from llm_support import clash, docs, no_docs, sf  # noqa: F401
from pyspark.sql import functions as F

from sparkwright.llm import catalog, chat

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(windows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}


def odd():
    long = [(7, k, ("user", "assistant")[k % 2], f"turn {k} " * (k % 13)) for k in range(60)]
    return [(1, 0, "system", "be kind <|im_end|>"), (1, 1, "user", "a\nb <\\| c"), (1, 2, "assistant", "<|im_start|>assistant ok"),
            (2, 0, "system", "alone"), (3, 0, None, None), (3, 1, "assistant", None), (3, None, "user", "first"),
            (None, 5, "user", "no id"), (None, 5, "assistant", "tie"), (4, 1, "user", "twice"), (4, 1, "user", "twice"),
            (5, 0, "odd\nrole%<|", "x"), (5, 1, "assistant", "é\U0001F600 <"), (6, 0, "user", "w " * 3000),
            (6, 1, "assistant", "z " * 9000), (8, 0, "assistant", "|im_end|>"), *long]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    want = brute(rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    have = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in catalog.op2_chat(spark, sf).collect()}
    assert have == want


@pytest.mark.parametrize("budget,history", [(2048, 512), (64, 20), (1, 0), (40, 1000)])
def test_odd_rows_read_back(spark, budget, history):
    df = clash(spark.createDataFrame(odd(), TURNS), "first", "i", "slice", "tokens", "kind", "conv", "t")
    assert got(chat.format_windows(df, budget, history)) == brute(odd())
    assert chat.format_windows(df.limit(0)).collect() == []


def test_slices_and_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(odd(), TURNS)
    key = lambda r: (r.conv_id is not None, r.conv_id, r["first"])
    want = sorted(chat.format_windows(df, 64, 20).collect(), key=key)
    monkeypatch.setattr(chat, "SLICE_TURNS", 4)
    assert sorted(chat.format_windows(df, 64, 20).collect(), key=key) == want
    monkeypatch.setattr(chat, "BLOCK_TURNS", 5)
    assert got(chat.format_windows(df, 64, 20)) == brute(odd())


def test_windows_keep_the_budget_the_system_turn_and_the_mask(spark):
    df = spark.createDataFrame(odd(), TURNS).union(spark.createDataFrame(
        [(9, 0, "system", "rules"), *((9, k, ("assistant", "user")[k % 2], "say it " * 5) for k in range(1, 40))], TURNS))
    rows = chat.format_windows(df, 80, 30, history_turns=3)
    for r in rows.withColumn("said", chat.read_turns(F.col("formatted"))).collect():
        fresh = r.n_turns - r.n_repeated
        assert r.n_tokens <= 80 or (r.over_budget and fresh <= 2)
        assert len(r.said) == r.n_turns
        if r.conv_id == 9:
            assert r.said[0].role == "system" and r.said[0].text == "rules"
            assert r.n_repeated <= 4
        own = r.said[r.n_repeated:]
        assert [chat_text(r.formatted, s) for s in r.loss_spans] == [
            t.text for t in own if t.role == "assistant"]


def chat_text(formatted, span):
    import re
    return re.sub(r"<(\\*)\\\|", r"<\1|", formatted[span.start:span.end])
