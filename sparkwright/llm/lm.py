"""Language-model scores from a probabilistic suffix tree over bytes.

A text is the byte string of its lower-cased words, each followed by one
space, the last by a line break, which no word holds. The tree's contexts are
byte strings of varying length. A context is kept if it was seen a few times,
its longest proper suffix is kept and its next-byte distribution diverges from
that suffix's; distributions are smoothed towards the suffix's. A byte is
scored by the longest kept suffix of what stands before it.

The tree is a Spark table that grows with the corpus. It is dealt into parts by
the last bytes of the contexts; a part has a bounded number of rows, and every
byte is scored against the one part that its context lies in.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import save_intermediate
from .common import crc_of_id, ship, text_slices

DEPTH = 6             # longest context, in bytes; up to 7, which with the next byte fill 64 bits
SHARED = 2            # contexts up to this length are part of every part of the tree
KEY_BYTES = 3         # longer ones are dealt by so many of their last bytes
MIN_COUNT = 2         # a context seen less often is not kept
DIVERGENCE = 1.0      # count * KL divergence in nats, per next byte seen, that keeps a context
PART_ROWS = 6_000_000   # rows of the tree that are broadcast at once, about
TASK_ROWS = 1_000_000   # distinct byte strings whose contexts a task decides on, about
HEAD_SHARE = 5e-7     # words at least so frequent are broadcast: at most 1/HEAD_SHARE of them
CHARS_AT_ONCE = 2 << 20
BYTES_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 1 << 17
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case (``bytes.split`` cuts at the contract's white space)."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def mask(d: int) -> np.uint64:
    """Bits of a context of ``d`` bytes and its next byte."""
    return np.uint64((1 << (8 * (d + 1))) - 1)


def grams(texts: list[list[bytes]], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of every byte with the ``depth`` bytes before it, and the number of its text,
    for a bounded number of bytes at a time. Before a text stand line breaks."""
    raw = [b"\n" * depth + b" ".join(w) + b"\n" for w in texts]
    ends = np.cumsum([len(r) for r in raw]) + 7
    starts = np.append(7, ends[:-1])[:len(ends)]
    buf = b"\n" * 7 + b"".join(raw)
    # The eight bytes up to each byte, read as one number at every place.
    eight = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))
    for s in range(7, len(buf), BYTES_AT_ONCE):
        e = min(s + BYTES_AT_ONCE, len(buf))
        code = eight[s - 7:e - 7].astype(np.uint64) & mask(depth)
        a, b = np.searchsorted(ends, s, side="right"), np.searchsorted(starts, e)
        owner = np.repeat(np.arange(a, b), np.minimum(ends[a:b], e) - np.maximum(starts[a:b], s))
        pads = (starts[a:b, None] + np.arange(depth)).ravel() - s
        real = np.ones(e - s, bool)
        real[pads[(pads >= 0) & (pads < e - s)]] = False
        yield code[real], owner[real]


def sums(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with its total."""
    names, own = np.unique(codes, return_inverse=True)
    return names, np.bincount(own, weights=n, minlength=len(names)).astype(np.int64)


def chain(codes: np.ndarray, n: np.ndarray, depth: int, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codes and counts for each context length from ``least`` to ``depth``."""
    out = {depth: sums(codes & mask(depth), n)}
    for d in range(depth - 1, least - 1, -1):
        out[d] = sums(out[d + 1][0] & mask(d), out[d + 1][1])
    return out


def lookup(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``names`` and whether they are there."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


def root(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and probabilities of the bytes without a context."""
    seen = np.bincount(codes.astype(np.int64), weights=n, minlength=256) + 0.5
    return np.arange(256, dtype=np.uint64), seen / seen.sum()


def grow(codes: np.ndarray, n: np.ndarray, d: int, below: tuple[np.ndarray, np.ndarray], divergence: float = DIVERGENCE):
    """Kept contexts of length ``d``: (codes, probabilities) of the next bytes seen after them,
    and (contexts, share that their unseen next bytes take of the suffix's distribution).

    ``codes`` are in order and hold every next byte of their contexts; ``below`` is the
    first of these pairs for ``d - 1``.
    """
    at, known = lookup(below[0], codes & mask(d - 1))
    codes, n, lower = codes[known], n[known], below[1][at[known]] if len(below[1]) else np.zeros(0)
    context = codes >> np.uint64(8)   # in order, as the codes are
    new = np.append(True, context[1:] != context[:-1])[:len(context)]
    names, own = context[new], np.cumsum(new) - 1
    kinds = np.bincount(own, minlength=len(names))
    size = np.bincount(own, weights=n, minlength=len(names))
    gain = np.bincount(own, weights=n * np.log(n / size[own] / lower), minlength=len(names))
    keep = (size >= MIN_COUNT) & (gain > divergence * kinds)
    p = (n + kinds[own] * lower) / (size + kinds)[own]
    return (codes[keep[own]], p[keep[own]]), (names[keep], (kinds / (size + kinds))[keep])


class Tree:
    """Levels of a tree, or of the part ``part`` of ``parts`` of it: for each context length
    the next bytes' codes and log10 probabilities, the contexts and their log10 shares."""

    def __init__(self, first: np.ndarray, levels: dict[int, tuple], depth: int, part: int = 0, parts: int = 1):
        self.first, self.levels, self.depth, self.part, self.parts = first, levels, depth, part, parts

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text, end included; of its bytes of this part only.

        Equal byte strings are looked up once, from the longest to the shortest and back.
        """
        total = np.zeros(len(texts))
        for code, owner in grams(texts, self.depth):
            if self.parts > 1:
                mine = part_of(code, self.parts) == self.part
                code, owner = code[mine], owner[mine]
            names, places = {}, {}
            names[self.depth], back = np.unique(code, return_inverse=True)
            for d in range(self.depth - 1, -1, -1):
                names[d], places[d] = np.unique(names[d + 1] & mask(d), return_inverse=True)
            value = self.first[names[0].astype(np.int64)]
            for d in range(1, self.depth + 1):
                value = value[places[d - 1]]
                if d not in self.levels:
                    continue
                (seen, logp), (contexts, share) = self.levels[d]
                at, known = lookup(contexts, names[d] >> np.uint64(8))
                value[known] += share[at[known]]
                at, known = lookup(seen, names[d])
                value[known] = logp[at[known]]
            total += np.bincount(owner, weights=value[back], minlength=len(texts))
        return total


def part_of(code: np.ndarray, parts: int) -> np.ndarray:
    """Part of the tree that the context of a code lies in, by its last bytes."""
    return (((code >> np.uint64(8)) & mask(KEY_BYTES - 1)) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(parts)


def part_column(key: Column, parts: int) -> Column:
    """``part_of`` for a column of the contexts' last bytes."""
    return F.shiftright(key * F.lit(2654435761), 16) % parts


def as_levels(kind: np.ndarray, code: np.ndarray, value: np.ndarray) -> dict[int, tuple]:
    """Levels from rows of the tree's table."""
    out = {}
    for d in np.unique(kind[kind > 0]).tolist():
        pair = []
        for k in (d, -d):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(code[at])]
            pair.append((code[at], value[at]))
        out[d] = tuple(pair)
    return out


def upper_levels(codes: np.ndarray, n: np.ndarray, depth: int = SHARED, divergence: float = DIVERGENCE):
    """Root probabilities, levels up to ``depth`` as ``Tree`` takes them, and the last level's probabilities."""
    counts = chain(codes, n, depth, 0)
    below = root(*counts[0])
    first, levels = np.log10(below[1]), {}
    for d in range(1, depth + 1):
        below, contexts = grow(*counts[d], d, below, divergence)
        levels[d] = (below[0], np.log10(below[1])), (contexts[0], np.log10(contexts[1]))
    return first, levels, below


def _train(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("held_out")).select("text")


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) of all training words; counted inside tasks first, then by Spark."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter()
            for t in batch.column(0).to_pylist():
                n.update(words_of(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
    return train.mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_grams(train: DataFrame, depth: int) -> DataFrame:
    """(code, n) of all strings of ``depth`` + 1 bytes; counted inside tasks first, then by Spark.

    The rows are dealt before Spark sums them: a task's strings are distinct already.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def merged():
            return sums(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))

        def out():
            codes, n = merged()
            held.clear()
            for s in range(0, len(codes), ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[s:s + ROWS_AT_ONCE].view(np.int64)), pa.array(n[s:s + ROWS_AT_ONCE])], names=["code", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in text_slices(texts, CHARS_AT_ONCE):
                for code, _ in grams([words_of(t) for t in texts[a:b]], depth):
                    held.append(np.unique(code, return_counts=True))
                    if sum(len(c) for c, _ in held) > 3_000_000:
                        held[:] = [merged()]
                        if len(held[0][0]) > 1_500_000:
                            yield from out()
        if held:
            yield from out()

    return train.mapInArrow(work, "code long, n long").repartition("code").groupBy("code").agg(F.sum("n").alias("n"))


def grow_tree(counts: DataFrame, depth: int, below: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, kind, code, value) of the kept contexts longer than SHARED: a next byte's log10
    probability (kind: the context's length) or a context's log10 share (kind: minus the length).

    Strings are dealt by the last KEY_BYTES bytes of their context, so that the suffixes of a
    context lie in its task but for those in ``below``, the last of the shared levels.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not held:
            return
        codes, n = np.concatenate([c for c, _ in held]), np.concatenate([m for _, m in held])
        held.clear()
        levels, lower = chain(codes, n, depth, SHARED + 1), below
        del codes, n
        for d in range(SHARED + 1, depth + 1):
            lower, contexts = grow(*levels.pop(d), d, lower)
            for kind, (code, p), shift in ((d, lower, 8), (-d, contexts, 0)):
                key = (code >> np.uint64(shift)) & mask(KEY_BYTES - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), pa.array(np.full(len(code), kind, np.int8)), pa.array(code.view(np.int64)),
                     pa.array(np.log10(p), pa.float32())], names=["key", "kind", "code", "value"])

    spark = counts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-counts.count() // TASK_ROWS))
    key = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(int(mask(KEY_BYTES - 1))))
    return counts.repartition(tasks, key).select("code", "n").mapInArrow(work, "key long, kind byte, code long, value float")


def score_documents(df: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score. ``depth``: SHARED + 1 to 7 bytes.

    Word counts and counts of byte strings cover all training texts, and the
    tree is a table of any size. What reaches the driver and every task is
    bounded: frequent words (at most 1/HEAD_SHARE; the counts of all other
    words are joined by word), the contexts of up to SHARED bytes (at most 2^24
    counts) and one part of the tree at a time (about PART_ROWS; a part holds
    at least all contexts that end in the same KEY_BYTES bytes). Texts are read
    once for each part, which is once for a tree of one part.

    Nulls: a null text is empty (one token, the end); a null id counts as the
    empty id, which is held out. Very long texts are read whole, a bounded
    number of bytes at a time. Repeated rows count and score each for itself;
    an empty training set leaves uniform probabilities; an empty table gives
    no rows; other columns are not read.
    """
    if not SHARED < depth <= 7:
        raise ValueError("depth is 3 to 7 bytes")
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), (crc_of_id(id_col) % 10 == 0).alias("held_out"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = _train(docs)
    vocabulary = save_intermediate(count_words(train), "lm-words")
    n_train = train.count()
    totals = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = (totals.n or 0) + n_train, totals.v + (n_train > 0)
    least = max(1.0, HEAD_SHARE * tokens)
    head = vocabulary.where(F.col("n") >= least).toArrow()
    known = dict(zip(head["word"].to_pylist(), head["n"].to_pylist()))
    del head

    counts = save_intermediate(count_grams(train, depth), "lm-grams")
    short = F.col("code").bitwiseAND(F.lit(int(mask(SHARED)))).alias("code")
    upper = counts.groupBy(short).agg(F.sum("n").alias("n")).toArrow()
    first, shared_levels, below = upper_levels(upper["code"].to_numpy().view(np.uint64), upper["n"].to_numpy())
    tree = save_intermediate(grow_tree(counts, depth, below), "lm-tree")
    parts = max(1, -(-tree.count() // PART_ROWS))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    if parts > 1:
        docs = save_intermediate(docs, "lm-docs")   # every part is read with the same row numbers

    def part_tree(part: int):
        rows = tree.where(part_column(F.col("key"), parts) == part).select("kind", "code", "value").toArrow()
        levels = as_levels(rows["kind"].to_numpy(), rows["code"].to_numpy().view(np.uint64), rows["value"].to_numpy())
        return Tree(first, shared_levels | levels, depth, part, parts)

    end_gain = math.log10(n_train + 0.1)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((part_tree(0), known))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_slices(texts, CHARS_AT_ONCE):
                words = [words_of(t) for t in texts[a:b]]
                n, n_known, base, ends, tail, times = [], [], [], [0], [], []
                for ws in words:
                    k, s = int(n_train > 0), end_gain
                    for w, m in Counter(ws).items():
                        c = known.get(w)
                        if c:
                            k += m
                            s += m * math.log10(c + 0.1)
                        else:
                            s -= m          # log10(0.1), put right where the word's count is joined
                            tail.append(w)
                            times.append(m)
                    n.append(len(ws) + 1)
                    n_known.append(k)
                    base.append(s)
                    ends.append(len(tail))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(tail, pa.binary()), pa.array(times, pa.int64())], names=["word", "m"]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in (0, 1, 3)), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(tree.score(words), pa.float64()), rare],
                    names=["doc_id", "held_out", "row", "n_tokens", "head_known", "head_base", "score", "rare"])

    scored = save_intermediate(docs.mapInArrow(
        work, f"doc_id {id_type}, held_out boolean, row long, n_tokens long, head_known long, head_base double, "
              "score double, rare array<struct<word: binary, m: bigint>>"), "lm-scored")
    shared.destroy()
    others = [save_intermediate(_part_scores(docs, part_tree(p)), "lm-scored") for p in range(1, parts)]
    if others:
        more = others[0]
        for o in others[1:]:
            more = more.unionByName(o)
        more = more.groupBy("row").agg(F.sum("score").alias("other"))
        scored = scored.join(more, "row").withColumn("score", F.col("score") + F.col("other")).drop("other")
    rare = scored.select("row", F.inline("rare")).join(vocabulary.where(F.col("n") < least), "word") \
        .groupBy("row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * (F.log10(F.col("n") + 0.1) + 1)).alias("gain"))
    norm = math.log10(tokens + 0.1 * (distinct + 1))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score")


def _part_scores(docs: DataFrame, tree: Tree) -> DataFrame:
    """(row, score): what one further part of the tree adds."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts, CHARS_AT_ONCE):
                score = shared.value.score([words_of(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], names=["row", "score"])

    return docs.select("row", "text").mapInArrow(work, "row long, score double")
