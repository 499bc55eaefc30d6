"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles. BagMinHash draws, for
each shingle, Poisson processes over the discretised weight axis; the first
point of each signature component is equal for two documents with the
probability of their weighted Jaccard similarity. Documents that agree in a
band are candidates, and candidates are verified on the multisets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, ship, text_slices
from .graph import components

SHINGLE = 5
BANDS, ROWS = 32, 4       # misses a pair at 0.8 with probability 5e-8
ONE_CELL = 64            # a bucket of more members is cut by size
CHARS_AT_ONCE = 2 << 20   # text worked on at a time inside a task
U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
POWER, INVERSE = U(0x5851F42D4C957F2D), U(pow(0x5851F42D4C957F2D, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator: a bijection of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salt(k: int) -> np.uint64:
    return U(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts in order, and the words of each text.

    A word's hash is a polynomial over its bytes, read off running sums of the
    whole buffer.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[buf] * _powers(POWER, len(buf)), dtype=np.uint64)])
    code = mix((sums[end] - sums[start]) * _powers(INVERSE, len(buf))[start] + (end - start).astype(np.uint64))
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return code, np.diff(np.searchsorted(start, first))


def shingles(code: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle; a text of fewer than five words is one shingle."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at = np.arange(len(code)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    take = np.flatnonzero(at <= np.maximum(n_words - SHINGLE, 0)[doc])
    padded = np.concatenate([code, np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(take), np.uint64)
    for k in range(SHINGLE):
        inside = at[take] + k < n_words[doc[take]]
        h = mix(h * POWER + np.where(inside, padded[take + k], U(0)) + U(k))
    return doc[take], h


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and how often it occurs."""
    key = h ^ mix(doc.astype(np.uint64) * GOLDEN + U(1))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] + U(1)))
    n = np.diff(np.append(first, len(key)))
    return doc[order[first]], h[order[first]], n


def bag_signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures (``n_docs`` x ``m``) of weighted elements with integer weights.

    The weight axis is cut at 1, 2, 4, ...; on each piece of width d that a
    weight reaches runs a Poisson process of rate m * d whose points carry a
    component and a level, both drawn from the element's own generator, and
    count if the level lies below the weight. Points come in ascending order,
    so a process ends as soon as its point passes the largest value of its
    document's signature: most elements end at their first point.
    """
    sig = np.full(n_docs * m, np.inf)
    pieces = int(weight.max(initial=1) - 1).bit_length()
    state, owner, below, width, base = [], [], [], [], []
    for j in range(pieces + 1):
        low, d = (0, 1) if j == 0 else (1 << (j - 1), 1 << (j - 1))
        on = weight > low
        state.append(mix(h[on] + salt(j + 1)))
        owner.append(doc[on])
        below.append(np.minimum(weight[on] - low, d))
        width.append(np.full(on.sum(), d))
        base.append(np.zeros(on.sum()))
    state, owner, below, width, x = map(np.concatenate, (state, owner, below, width, base))
    turn = 0
    while len(state):
        r1 = mix(state + salt(2 * turn + 1))
        r2 = mix(state + salt(2 * turn + 2))
        x = x - np.log((np.maximum(r1 >> U(11), U(1))).astype("float64") * 2.0**-53) / (m * width)
        level = (r2 >> U(32)) % width.astype(np.uint64)
        hit = level < below.astype(np.uint64)
        part = (r2 & U(0xFFFFFFFF)) % U(m)
        np.minimum.at(sig, owner[hit] * m + part[hit].astype("int64"), x[hit])
        go = x < sig.reshape(n_docs, m).max(axis=1)[owner]
        state, owner, below, width, x = state[go], owner[go], below[go], width[go], x[go]
        turn += 1
    return sig.reshape(n_docs, m)


def sign(texts: list[str], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, list]:
    """For each text: two 64-bit keys of its word sequence and its band hashes (None without words)."""
    code, n = word_hashes(texts)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    keys = []
    for k in (1, 2):
        total = np.zeros(len(n), np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            terms = mix(code + mix(at.astype(np.uint64) * GOLDEN + U(k)))
            total[some] = np.add.reduceat(terms, (np.cumsum(n) - n)[some])
        keys.append(mix(total + n.astype(np.uint64)).view(np.int64))
    m = bands * rows
    sig = bag_signatures(*counted(*shingles(code, n)), len(n), m).view(np.uint64).reshape(len(n), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(n), bands))
    for k in range(rows):
        h = mix(h * POWER + sig[:, :, k])
    h = h.view(np.int64)
    return keys[0], keys[1], [h[i] if n[i] else None for i in range(len(n))]


def bag(text: str) -> np.ndarray:
    """Sorted hashes of the text's shingles; the k-th occurrence of one has a hash of its own."""
    doc, h, n = counted(*shingles(*word_hashes([text])))
    again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(mix(np.repeat(h, n) + again.astype(np.uint64) * GOLDEN))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two bags."""
    return len(np.intersect1d(a, b, assume_unique=True))


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, _hash, _k1, _k2, _bands and a row number, written once."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_slices(texts, CHARS_AT_ONCE):
                k1, k2, h = sign(texts[a:b], bands, rows)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(k1), pa.array(k2), pa.array(h, pa.list_(pa.int64()))],
                    names=["doc_id", "_hash", "_k1", "_k2", "_bands"])

    signed = docs.mapInArrow(work, f"doc_id {id_type}, _hash long, _k1 long, _k2 long, _bands array<long>")
    return cut_lineage(signed.withColumn("_row", F.monotonically_increasing_id()))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the overlap ``o`` of their bags and their weighted Jaccard similarity ``j``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
                    for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            o = [overlap(a, b) for a, b in bags]
            j = [n / max(1, len(a) + len(b) - n) for n, (a, b) in zip(o, bags)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(o, pa.int64()), pa.array(j, pa.float64())],
                names=["u", "v", "o", "j"])

    left = bags.select(F.col("_row").alias("u"), F.col("_bag").alias("_a"))
    right = bags.select(F.col("_row").alias("v"), F.col("_bag").alias("_b"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "_a", "_b")
    return both.mapInArrow(work, "u long, v long, o long, j double")


def _common(bags: DataFrame) -> DataFrame:
    """Per document (v) of ``bags``: its bag's size, and how much of it (common) other bags hold too."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row)), pa.array(h)], names=["v", "h"])

    alone = bags.select("_row", "_bag").mapInArrow(work, "v long, h long") \
        .groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).where("n = 1") \
        .groupBy("v").agg(F.count(F.lit(1)).alias("alone"))
    sizes = bags.select(F.col("_row").alias("v"), (F.octet_length("_bag") / 8).cast("long").alias("size"))
    return sizes.join(alone, "v", "left").select(
        "v", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _open_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (u < v) of members of one bucket that may still be linked.

    ``placed``: key, v, root, o (overlap with the pivot), d (distance to it),
    beside (other shingles that a second document holds), size, common, keys.

    A link between sizes s <= t takes an overlap of threshold * (s + t) /
    (1 + threshold), which neither common part exceeds. So the smaller text
    needs nearly all of itself in common, and the larger one bounds the sizes
    that it can meet. The join is on the bucket and, in buckets of more than
    ``ONE_CELL`` members, a cell of sizes within these bounds: texts that
    share a template but stay below the threshold make no pair, however many
    they are.
    """
    share = threshold / (1 + threshold)
    step = max(1.02, max(threshold, 1e-3) ** -0.5)
    least = F.greatest(F.ceil(threshold * F.col("size") - 1e-6), F.lit(1))
    reach = F.least(F.floor(F.col("common") / share - F.col("size") + 1e-6), "size")
    placed = placed.withColumn("small", F.col("common") >= 2 * share * F.col("size") - 1e-6) \
        .withColumn("large", least <= reach)
    # Per bucket: its largest class, and how many could be the smaller or larger text of a pair, in it and in all.
    first = F.struct("n", "root")
    main = placed.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("small").alias("s"), F.count_if("large").alias("l")) \
        .groupBy("key").agg(F.max_by("root", first).alias("main"), F.sum("n").alias("members"),
                            F.sum("s").alias("all_s"), (F.sum("s") - F.max_by("s", first)).alias("other_s"),
                            F.sum("l").alias("all_l"), (F.sum("l") - F.max_by("l", first)).alias("other_l"))
    placed = placed.join(main, "key").withColumn("inside", F.col("root") == F.col("main"))
    cell = lambda size: F.when(F.col("members") <= ONE_CELL, F.lit(0).cast("long")).otherwise(
        F.floor(F.log(size) / F.lit(np.log(step)) + 1e-9))
    small = placed.where(F.col("small") & (F.when(F.col("inside"), F.col("other_l")).otherwise(F.col("all_l")) > 0)) \
        .select("key", cell(F.col("size")).alias("cell"), "inside", "v", "root", "d", "o", "beside", "size", "keys")
    # Members of a bucket's largest class meet others only.
    meets = F.when(F.col("inside"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    large = placed.where(F.col("large") & (F.when(F.col("inside"), F.col("other_s")).otherwise(F.col("all_s")) > 0)) \
        .withColumn("cell", F.explode(F.sequence(cell(least), cell(reach)))) \
        .withColumn("inside", F.explode(meets)) \
        .select("key", "cell", "inside", reach.alias("reach"),
                *[F.col(c).alias(c + "1") for c in ("v", "root", "d", "o", "beside", "size", "keys")])
    most = F.least("o", "o1") + F.least("beside", "beside1")
    near = (F.abs(F.col("d") - F.col("d1")) <= 1 - threshold + 1e-9) \
        & (most >= threshold * (F.col("size") + F.col("size1") - most) - 1e-9)
    # Of equal sizes each pair once, and every pair only in the first bucket it shares.
    once = ((F.col("size") < F.col("size1")) | (F.col("v") < F.col("v1"))) \
        & (F.col("key") == F.array_min(F.array_intersect("keys", "keys1")))
    fits = (F.col("size") <= F.col("reach")) & (F.col("root") != F.col("root1")) & near & once
    return small.join(large, ["key", "cell", "inside"]).where(fits) \
        .select(F.least("v", "v1").alias("u"), F.greatest("v", "v1").alias("v")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, and _root (a number of the class) and _hash (of the text).

    A class is a connected component of the links between texts of weighted
    Jaccard similarity ``threshold`` or more; class_id is its least doc_id.

    Copies (equal lower-cased word sequences) are one vertex. In each bucket
    of documents that agree in a band every member is verified against one,
    the pivot; most buckets end there as one class. In the others
    every pair of members of different classes that includes one outside the
    bucket's largest class is verified too, except where it cannot be linked:
    where the two distances to the pivot differ by more than 1 - threshold
    (Jaccard distance is a metric), or where the overlap would be too small
    even if the lesser overlap with the pivot were shared whole and so were
    the lesser number of other shingles that occur in a second document. Sizes
    and common parts decide most of that before a pair is made. No pair is
    left out otherwise.

    Nulls: a null text is empty; texts without words are equal and form one
    class. A null doc_id is a vertex like any other; a class of null ids only
    has a null class_id. Repeated rows share a class. Texts of one to four
    words are one shingle. An empty table gives no rows.
    """
    ship(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    signed = _signed(docs, bands, rows)
    least = signed.groupBy("_k1", "_k2").agg(F.min("_row").alias("_node"))
    members = cut_lineage(signed.select("doc_id", "_hash", "_k1", "_k2", "_row").join(least, ["_k1", "_k2"])
                          .select("doc_id", "_hash", "_row", "_node"))
    nodes = signed.join(least.select(F.col("_node").alias("_row")), "_row", "left_semi")
    entries = nodes.select(F.col("_row").alias("v"), F.explode("_bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = cut_lineage(entries.join(shared, "key"))
    # The member that meets most others, over all its bands, is a bucket's pivot:
    # of a text and its many edited copies that is the text.
    known = entries.groupBy("v").agg(F.sum("n").alias("meets"))
    entries = entries.join(known, "v")
    pivots = entries.groupBy("key").agg(F.max_by("v", F.struct("meets", -F.col("v"))).alias("u"))
    entries = cut_lineage(entries.select("key", "v").join(pivots, "key"))
    texts = members.join(entries.select(F.col("v").alias("_row")).distinct(), "_row", "left_semi") \
        .select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "_row")

    def to_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], names=["_row", "_bag"])

    held = docs.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))) \
        .select("_row", "text").mapInArrow(to_bags, "_row long, _bag binary")
    bags = cut_lineage(held).dropDuplicates(["_row"])

    first = cut_lineage(_verified(entries.where("u != v").select("u", "v").distinct(), bags))
    roots = components(first.where(F.col("j") >= threshold))
    placed = entries.join(roots.select(F.col("vertex").alias("v"), "root"), "v", "left") \
        .join(first, ["u", "v"], "left") \
        .select("key", "u", "v", F.coalesce("root", "v").alias("root"), "o",
                F.when(F.col("u") == F.col("v"), 0.0).otherwise(1 - F.col("j")).alias("d"))
    split = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key")
    placed = cut_lineage(placed.join(split, "key", "left_semi"))
    facts = cut_lineage(_common(bags.join(placed.select(F.col("v").alias("_row")).distinct(), "_row", "left_semi"))
                        .where(F.col("common") >= threshold * F.col("size"))
                        .join(placed.groupBy("v").agg(F.sort_array(F.collect_list("key")).alias("keys")), "v"))
    placed = placed.join(facts, "v") \
        .withColumn("o", F.when(F.col("u") == F.col("v"), F.col("size")).otherwise(F.col("o"))) \
        .withColumn("beside", F.greatest(F.col("common") - F.col("o"), F.lit(0)))
    rest = _open_pairs(placed, threshold)
    tried = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = rest.join(tried, ["u", "v"], "left_anti")
    second = _verified(rest, bags).where(F.col("j") >= threshold)
    # What the second links join are classes found so far: components of their roots.
    for end in ("u", "v"):
        second = second.join(roots.select(F.col("vertex").alias(end), F.col("root").alias("_r")), end, "left") \
            .withColumn(end, F.coalesce("_r", end)).drop("_r")
    joined = components(second.select("u", "v"))
    rooted = members.join(roots.select(F.col("vertex").alias("_node"), "root"), "_node", "left") \
        .withColumn("root", F.coalesce("root", "_node"))
    rooted = rooted.join(joined.select(F.col("vertex").alias("root"), F.col("root").alias("_r")), "root", "left") \
        .withColumn("root", F.coalesce("_r", "root"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rooted.join(ids, "root").select("doc_id", "class_id", F.col("root").alias("_root"), "_hash")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` (with doc_id and text) with one row of each class, all columns unchanged.

    The row with the least doc_id stays (of rows with that id the one whose
    text has the least hash, of equal rows any).
    """
    kept = classes(docs, threshold=threshold).groupBy("_root") \
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")).alias("k")) \
        .select(F.col("k.doc_id").alias("_id"), F.col("k._hash").alias("_h"))
    h, n = fresh(docs, "_hash"), fresh(docs, "_nth")
    rows = docs.withColumn(h, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows[h] == kept["_h"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", h).orderBy("doc_id"))
    return rows.withColumn(n, nth).where(F.col(n) == 1).select(*docs.columns)
