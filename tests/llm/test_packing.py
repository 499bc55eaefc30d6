from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_support import clash, docs, no_docs, sf  # noqa: F401
from tokenizers import Tokenizer

from sparkwright.llm import catalog, packing
from sparkwright.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, docs, tokenizer, capacity=1024):
    """Every document's ids are there once, in pieces, and sequences are filled without gaps."""
    left = {}
    for r in rows:
        left.setdefault(r.doc_id, []).append(r)
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append(tokenizer.encode(t, add_special_tokens=False).ids + [2])
    assert left.keys() == want.keys()
    for d, many in want.items():
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in left[d])
        pieces = []
        for ids in many:
            first = len(ids) - capacity * ((len(ids) - 1) // capacity)
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            pieces += [(k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()))
                       for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert got == sorted(pieces)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_query(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = catalog.op4_packing(spark, sf).collect()
    n = check(rows, docs, tokenizer)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 2


def test_odd_rows(docs, no_docs, tokenizer):
    odd = [(r.doc_id, r.text or "") for r in docs.collect()]
    check(packing.pack_documents(clash(docs, "piece", "length", "sequence_id", "_row"), PATH).collect(), odd, tokenizer)
    assert packing.pack_documents(no_docs, PATH).collect() == []


def test_several_groups(docs, tokenizer):
    pieces = packing.token_pieces(docs, PATH, 64)
    odd = [(r.doc_id, r.text or "") for r in docs.collect()]
    check(packing.pack(pieces, 64, items_per_group=3).collect(), odd, tokenizer, 64)


def test_rule_picks_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 33, 300)
    seq, offset = packing.place(lengths, 32)
    fill = {}
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        gaps = [32 - f for s, f in fill.items() if f < 32]
        fits = sorted({g for g in gaps if g >= size})
        if fits:
            def after(g):
                left = list(gaps)
                left.remove(g)
                left += [g - size] if g > size else []
                return sum(left.count(x) ** 2 for x in set(left))
            assert after(32 - offset[i]) == min(map(after, fits))
        else:
            assert offset[i] == 0 and seq[i] not in fill
        fill[seq[i]] = fill.get(seq[i], 0) + size
    assert max(fill.values()) <= 32
    assert len(fill) <= 1.02 * -(-lengths.sum() // 32) + 1


def test_sequences_hold_the_ids(docs, tokenizer):
    packed = packing.pack_documents(docs, PATH, keep_ids=True).cache()
    seqs = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r.sequence_id].ids[r.offset:r.offset + r.length] == r.ids


def test_encoder_equals_tokenizers(tokenizer):
    e = encoder(PATH)
    assert e.ranks is not None
    texts = ["", " ", "a  b", "a\n b", " a ", "x\ty \tz", "it's <|endoftext|> b", "é  b", "x" * 3000, "\x00 \x01", "あ\U0001F600"]
    plain = [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == plain and e.encode(texts[::-1]) == plain[::-1]
