"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf message, without the library that wrote
it: pieces with scores and kinds, the trainer's model type, the normaliser.
From these a ``tokenizers`` pipeline is rebuilt, whose ids are checked against
the original implementation.
"""

from __future__ import annotations

import functools
import operator
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices

MARK = "▁"
# Fixed values of the public message definition: field numbers and kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CHARS_AT_ONCE = 2 << 20
WORDS_AT_ONCE, CACHE_WORDS = 4096, 300_000


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def message(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protobuf message; nested messages and strings stay bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at:at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", raw, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", raw, at)[0], at + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass(frozen=True)
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    suffix_marker: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze_spaces: bool
    escape_spaces: bool

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse(raw: bytes) -> Spec:
    pieces, trainer, norm = [], {}, {}
    for field, value in message(raw):
        if field == PIECES:
            p = dict(message(value))
            pieces.append((p[1].decode("utf-8"), p.get(2, 0.0), p.get(3, NORMAL)))
        elif field == TRAINER:
            trainer = dict(message(value))
        elif field == NORMALIZER:
            norm = dict(message(value))
    return Spec(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0)),
                norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best merged piece first."""
    ids = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p, i in ids.items():
        for cut in range(1, len(p)):
            a, b = ids.get(p[:cut]), ids.get(p[cut:])
            if a is not None and b is not None:
                found.append((-spec.pieces[i][1], a, b, (p[:cut], p[cut:])))
    return [pair for *_, pair in sorted(found)]


def separable(spec: Spec) -> bool:
    """Words can be encoded one by one: no piece holds a marker after another character."""
    return spec.escape_spaces and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in spec.pieces)


def build(spec: Spec):
    """The ``tokenizers`` pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    if spec.suffix_marker:
        raise ValueError("models that mark words at their end are not supported")
    unknown = spec.pieces[spec.unknown][0]
    if spec.kind == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), unk_token=unknown,
                           fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.kind}")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if separable(spec):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []))
    return t


class Codec:
    """Encoder and decoder of one model file, checked against the original library.

    Where words can be encoded one by one, each distinct word of a call is
    encoded, and its ids decoded, once; what was found for at most twice
    ``CACHE_WORDS`` words is kept for the next calls. A piece that can be
    joined from several pairs has merges of equal score, whose order the two
    libraries resolve differently. So every distinct word is compared, and
    every text that is not encoded by words; the original's ids stand where
    they differ.
    """

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        with open(path, "rb") as f:
            spec = parse(f.read())
        self.tokenizer = build(spec)
        self.marked = np.array([p.startswith(MARK) for p, _, _ in spec.pieces])
        self.by_word = (separable(spec) and spec.dummy_prefix and not spec.charsmap and not spec.squeeze_spaces
                        and any(p == MARK for p, _, _ in spec.pieces))
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.differences = 0
        self.new: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _learn(self, words: list[str]) -> None:
        """Encode words as long texts, in parallel, and decode their ids.

        The first id of a word, and no other, has a mark, which tells the words apart again. The original
        encodes the same long texts, and each word by itself where any id differs.
        """
        parts = [words[at:at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)]
        joined = [" ".join(p) for p in parts]
        wanted = self.original.encode(joined)
        found = []
        for part, want, e in zip(parts, wanted, self.tokenizer.encode_batch(joined, add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            raw, at = ids.tobytes(), (np.flatnonzero(self.marked[ids]) * 4).tolist()
            own = [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
            if len(own) != len(part) or not np.array_equal(ids, want):
                right = [np.asarray(x, "<u4").tobytes() for x in self.original.encode(part)]
                self.differences += sum(map(operator.ne, own, right))
                own = right
            found.append(own)
        texts = self.decode([np.frombuffer(b"".join(own), "<u4") for own in found])
        for part, own, text in zip(parts, found, texts):
            back = text.split(" ")
            if len(back) != len(part):  # some word's ids hold spaces of their own
                back = self.decode([np.frombuffer(x, "<u4") for x in own])
            self.new.update(zip(part, zip(own, back, strict=True), strict=True))

    def _by_word(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        words = [t.split(" ") for t in texts]
        missing = set().union(*words).difference(self.new)
        known = missing.intersection(self.old)
        self.new.update((w, self.old[w]) for w in known)
        self._learn(list(missing - known))
        new = self.new
        out = []
        for ws in words:
            found = [new[w] for w in ws]
            out.append((np.frombuffer(b"".join([f[0] for f in found]), "<u4"), " ".join([f[1] for f in found])))
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}
        return out

    def round_trip(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, and what they decode to."""
        odd = [not t or "  " in t or MARK in t or t[0] == " " or t[-1] == " " for t in texts]
        plain = [i for i, o in enumerate(odd) if self.by_word and not o]
        out = dict(zip(plain, self._by_word([texts[i] for i in plain]))) if plain else {}
        rest = [i for i in range(len(texts)) if i not in out]
        some = [texts[i] for i in rest]
        found = []
        for e, want in zip(self.tokenizer.encode_batch_fast(some, add_special_tokens=False), self.original.encode(some)):
            ids, want = np.asarray(e.ids, "<u4"), np.asarray(want, "<u4")
            self.differences += not np.array_equal(ids, want)
            found.append(want)
        out.update(zip(rest, zip(found, self.decode(found))))
        return [out[i] for i in range(len(texts))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for ids, _ in self.round_trip(texts)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids, by the decoder of ``tokenizers``."""
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=True)


@functools.cache
def codec(path: str) -> Codec:
    """One codec per Python worker and model file."""
    return Codec(path)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids_crc32 (of
    little-endian unsigned 32-bit ids), ids, decoded (the text read back).

    Whole texts, row by row: no shuffle. Null texts are empty and have no ids; a null id stays null; repeated
    rows are encoded alike; an empty table gives no rows; other columns are not read.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts, CHARS_AT_ONCE):
                ids, decoded = zip(*c.round_trip(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                     pa.array([x.astype("int32") for x in ids], pa.list_(pa.int32())),
                     pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_crc32", "ids", "decoded"])

    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_crc32 long, ids array<int>, decoded string"
    return rows.mapInArrow(work, schema)
