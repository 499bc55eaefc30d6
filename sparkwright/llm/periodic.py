"""Periodic runs of words, by an online sparse dynamic program over lags.

Words are read one by one. A lag q is active while each word equals the one q
places before; its match length grows by one with every word. Where it fails,
the diagonal ends, and a match that is long enough leaves as a run at once.
New lags come from the earlier occurrences of the word.

Which earlier occurrence opens a lag is what keeps the program sparse. A run
of period q holds 3q matched words at least, so its word recurs together with
the ``3q`` words before it: each range of lags (``lag_ranges``) looks words up
with a context of ``size`` words, size at most 3q and at least 2q - 1. Of a
context that long only the last earlier occurrence can be one period back (two
occurrences less than q apart would give the run a smaller period), so a word
costs one look-up per range. The ranges grow by half, hence the time for n
words grows with n log n, also for one word repeated a million times, and every
lag that is opened is the smallest period of its stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, fresh, ship, text_slices, words_of

LEAST_LENGTH = 6     # words of a run
REPEATS = 4          # periods of a run
CONTEXT = 5          # words that every match has: the shortest is a run of 6 words, period 1
PRIME = (1 << 61) - 1
BASE = 0x5DEECE66D1B54A33 % PRIME
MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE_CHARS = 4_000_000

RUNS = "array<struct<start:long,length:long,period:long>>"


def lag_ranges(words: int) -> list[tuple[int, int, int]]:
    """(context size, least lag, largest lag) for runs that fit into ``words`` words."""
    out, least = [(CONTEXT, 1, (CONTEXT + 1) // 2)], (CONTEXT + 1) // 2 + 1
    while REPEATS * least <= words:
        size = (REPEATS - 1) * least
        out.append((size, least, (size + 1) // 2))
        least = (size + 1) // 2 + 1
    return out


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in ``words``, by start, then period."""
    n = len(words)
    ranges = [(size, low, high, pow(BASE, size, PRIME), {}) for size, low, high in lag_ranges(n)]
    names: dict = {}
    prefix = [0]
    active: dict[int, int] = {}
    out = []

    def ended(lag: int, matched: int, end: int) -> None:
        length = matched + lag
        if length >= LEAST_LENGTH and length >= REPEATS * lag:
            out.append((end - length, length, lag))

    for i, word in enumerate(words):
        prefix.append((prefix[-1] * BASE + names.setdefault(word, len(names) + 1)) % PRIME)
        for lag in list(active):
            if words[i - lag] == word:
                active[lag] += 1
            else:
                ended(lag, active.pop(lag), i)
        for size, low, high, power, last in ranges:
            if i + 1 < size:
                break
            context = (prefix[i + 1] - prefix[i + 1 - size] * power) % PRIME
            before = last.get(context)
            last[context] = i
            if before is not None and low <= (lag := i - before) <= high and lag not in active:
                if words[i - size + 1:i + 1] == words[before - size + 1:before + 1]:
                    active[lag] = size
    for lag, matched in active.items():
        ended(lag, matched, n)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_stretches(words: list) -> list[tuple[int, int]]:
    """Ranges of words outside which no run can be: all ``CONTEXT``-word
    windows inside a run occur twice in the text."""
    n = len(words) - CONTEXT + 1
    if n < 2:
        return []
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    window = np.zeros(n, np.uint64)
    for k in range(CONTEXT):
        window = (window + codes[k:k + n]) * MIX
        window ^= window >> np.uint64(29)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n + 2, np.int8)
    twice[order[1:][same] + 1] = 1
    twice[order[:-1][same] + 1] = 1
    edges = np.diff(twice)
    return [(int(a), int(b) + CONTEXT - 1) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))
            if b - a + CONTEXT - 1 >= LEAST_LENGTH]


def find(words: list) -> list[tuple[int, int, int]]:
    """Every run of a text's words, by start, then period."""
    return [(a + start, length, period) for a, b in repeated_stretches(words)
            for start, length, period in runs_of(words[a:b])]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but for those that a run contains after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def add_runs(df: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """``df`` with every periodic run of ``text_col`` and the collapsed text.

    ``runs_col``: array of (start, length, period) in words, by start, then
    period. A run is a stretch of words with smallest period q, at least
    ``max(6, 4q)`` words long, that cannot be longer. ``collapsed_col``: the
    words that no run contains after its first q words, joined by one space.

    Works row by row, without a shuffle; a task holds the words of one text
    at a time, however long, and time grows with n log n for n words. Null
    and empty texts have no words, no runs and an empty collapsed text;
    repeated rows are treated alike; an empty table gives an empty one. Other
    columns pass through, and columns of the new names must not exist.
    """
    taken = {c.lower() for c in df.columns}
    if {runs_col.lower(), collapsed_col.lower()} & taken:
        raise ValueError(f"{runs_col} and {collapsed_col} must be new column names")
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{runs_col}` {RUNS}", f"`{collapsed_col}` string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in text_slices(texts, SLICE_CHARS):
                found, short = [], []
                for text in texts[a:b]:
                    words = text.encode().split()     # splits at the six ASCII white space characters only
                    runs = find(words)
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    short.append(b" ".join(collapse(words, runs)).decode())
                columns = [*batch.slice(a, b - a).columns, pa.array(found, kind), pa.array(short, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, runs_col, collapsed_col])

    return df.mapInArrow(work, schema)


def planted(text: Column, id_code: Column) -> Column:
    """The query's text: where ``id_code`` (CRC-32 of the id) ends in 0, the
    words from a place on repeat a block, as the query's contract lays down."""
    words = words_of(text)
    g = F.floor(id_code / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    return F.when((F.pmod(id_code, F.lit(10)) == 0) & (F.size(words) > 0),
                  F.get(F.transform(F.array(words), repeat), 0)).otherwise(text)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns for every row of ``df``: its text is planted, then
    its runs are found. Null texts have no words; a null id stays null and
    counts as the empty text for the rule; repeated rows are all returned."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", planted(F.col("text"), crc_of_id()).alias("text"))
    rows = add_runs(rows)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    rows = rows.withColumn(fresh(rows, "best"), best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best")["col2"]).alias("start"), F.col("best")["length"].alias("length"), (-F.col("best")["col3"]).alias("period"),
        F.floor(F.col("best")["length"] * 1000 / -F.col("best")["col3"]).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
