from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm_support import clash, docs, no_docs, sf  # noqa: F401

from sparkwright.llm import catalog
from sparkwright.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a   b", " a", "a ", "\n\n x", "日本 ∆ \U0001F600", "▁a ▁", "<s> x </s> <unk>", "<0x41>", "a" * 2000, "\x00",
       "       x" + " " * 20, "é́   x"]


@pytest.fixture(scope="module")
def original():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_message_is_read_like_the_library_does(original):
    spec = S.parse(open(PATH, "rb").read())
    assert [p[0] for p in spec.pieces] == [original.id_to_piece(i) for i in range(original.get_piece_size())]
    assert all(abs(p[1] - original.get_score(i)) < 1e-6 for i, p in enumerate(spec.pieces))
    assert spec.unknown == original.unk_id() and spec.byte_fallback


def test_parity(original):
    c = S.Codec(PATH)
    assert [x.tolist() for x in c.encode(ODD)] == [original.encode(t) for t in ODD]
    want = [original.decode(original.encode(t)) for t in ODD]
    assert c.decode(c.encode(ODD)) == want and c.decode(c.encode(ODD[::-1])) == want[::-1]


def test_unigram_models_are_rebuilt():
    """A small unigram message built by hand: scores decide, unknown bytes fall back."""
    def field(n, kind, raw):
        out, k = b"", n << 3 | kind
        while k > 127:
            out, k = out + bytes([k & 127 | 128]), k >> 7
        return out + bytes([k]) + raw

    def text(n, raw):
        return field(n, 2, bytes([len(raw)]) + raw)

    def piece(p, score, kind=1):
        return text(1, text(1, p.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind])))

    raw = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{b:02X}>", -20, 6) for b in range(256)) \
        + piece("▁", -3) + piece("▁ab", -1) + piece("a", -4) + piece("b", -4) + piece("bc", -2) + piece("c", -5)
    raw += text(2, field(3, 0, b"\x01") + field(35, 0, b"\x01")) + text(3, field(4, 0, b"\x00"))
    t = S.build(S.parse(raw))
    assert t.encode("ab abc a", add_special_tokens=False).tokens == ["▁ab", "▁ab", "c", "▁", "a"]
    assert t.encode("é", add_special_tokens=False).tokens == ["▁", "<0xC3>", "<0xA9>"]
    assert t.decode(t.encode("ab é c").ids) == "ab é c"


def test_query_equals_the_original(spark, sf, original):
    rows = {r.doc_id: r for r in catalog.op10_sentencepiece(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = original.encode(d.text or "")
        r = rows.pop(d.doc_id)
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        assert r.decoded_crc32 == zlib.crc32(original.decode(ids).encode())
    assert not rows


def test_odd_rows(docs, no_docs, original):
    rows = S.encode(clash(docs, "ids", "n_tokens"), PATH).collect()
    want = sorted(((r.doc_id is not None, r.doc_id, original.encode(r.text or "")) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id is not None, r.doc_id, r.ids) for r in rows), key=str) == want
    assert S.encode(no_docs, PATH).collect() == []


def test_every_word_is_compared(original):
    """A word that the rebuilt tokenizer encodes otherwise, anywhere in any text of a call, gets the original's ids."""
    class Wrong:
        def __init__(self, t):
            self.t = t

        def __getattr__(self, name):
            return getattr(self.t, name)

        def encode_batch(self, texts, **k):
            return self.t.encode_batch([t.replace("river", "rivet") for t in texts], **k)

    texts = ["one plain text", "the second has a river in it", "river", "and more"]
    c = S.Codec(PATH)
    c.tokenizer = Wrong(c.tokenizer)
    assert [x.tolist() for x in c.encode(texts)] == [original.encode(t) for t in texts]
    assert c.differences == 1


class Counting:
    """A tokenizer that counts the ids it decodes."""

    def __init__(self, t, change=lambda text: text):
        self.t, self.change, self.ids = t, change, 0

    def __getattr__(self, name):
        return getattr(self.t, name)

    def decode_batch(self, ids, **k):
        self.ids += sum(map(len, ids))
        return [self.change(x) for x in self.t.decode_batch(ids, **k)]


def test_every_word_is_decoded_once(spark, original, monkeypatch):
    """The rows of a task decode the ids of each distinct word, not of each text."""
    texts = [f"the river {w} runs\nto the sea" for w in ("日本", "😀é", "a\x00b", "old")] * 50
    c = S.Codec(PATH)
    c.tokenizer = Counting(c.tokenizer)
    monkeypatch.setattr(S, "codec", lambda path: c)
    monkeypatch.setattr(S, "ship", lambda spark: None)

    class Rows:  # stands for a DataFrame whose one partition is run here
        sparkSession, schema = spark, spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            return list(work(iter([pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})])))

    rows = [r for b in S.encode(Rows(), PATH) for r in b.to_pylist()]
    assert [r["ids"] for r in rows] == [original.encode(t) for t in texts] and [r["decoded"] for r in rows] == texts
    words = {w for t in texts for w in t.split(" ")}
    assert c.tokenizer.ids == sum(len(original.encode(w)) for w in words)


@pytest.mark.parametrize(("at_once", "kept"), [(1, 0), (3, 5), (4096, 300_000)])
def test_words_in_any_portions(original, monkeypatch, at_once, kept):
    """Portions and kept words of any size give the ids and texts of whole texts."""
    monkeypatch.setattr(S, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(S, "CACHE_WORDS", kept)
    texts = [*ODD, "one\ntwo\n\nthree", "\xa0x \u3000 y", "été über 日本語\nテキスト 👩\u200d🚀", "x" * 300 + " y"]
    c = S.Codec(PATH)
    for part in (texts, texts[::-1], texts[3:9], texts):
        found = c.round_trip(part)
        assert [ids.tolist() for ids, _ in found] == [original.encode(t) for t in part]
        assert [back for _, back in found] == c.decode([ids for ids, _ in found]) == [original.decode(original.encode(t)) for t in part]


def test_words_that_decode_to_spaces():
    """Words are told apart also where the ids of one decode to spaces."""
    c = S.Codec(PATH)
    c.tokenizer = Counting(c.tokenizer, lambda text: text.replace("~", " "))
    assert [back for _, back in c.round_trip(["one a~b two", "two one"])] == ["one a b two", "two one"]
