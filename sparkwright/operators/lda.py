"""Online variational LDA whose terms are dealt over the cluster (X11).

Spark's ``LDA`` holds a number for each term and topic in the driver and in
every task. Here a term is named by 64 bits of its hash, and what is known of it
lives in the part that the name falls into. A term's row of topic weights is
``scale * (draw + gain) + shift``: the draw it began with is a function of its
name, ``scale`` and ``shift`` are the same for all terms, and the gain from the
mini-batches is stored where it is not zero, in a few topics for most
terms. A mini-batch is read in blocks of documents: a block asks the
parts for the gains of its own terms, fits its documents and sends back what
they add; the driver holds a few numbers for each topic.

The steps, their constants and the stopping rule are those of Spark's online
optimizer; its draws (first weights, documents of a mini-batch) come from
hashes of term and document instead of a generator, so a lost part is computed
again with the same numbers.
"""

from __future__ import annotations

import functools
import itertools
import math
import pickle
import statistics

import numpy as np
from pyspark import StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save_intermediate, ship_library

# Defaults of Spark's estimator.
OFFSET, DECAY, SHARE, SHAPE, CHANGE = 1024.0, 0.51, 0.05, 100.0, 1e-3
DEAD = 1e-20            # a topic below this share of a document can't come back: weights in a term differ far less
DOCS_PER_BLOCK, BLOCKS_PER_PART = 10_000, 4   # where that gives more blocks and parts than there are cores
TOGETHER, FEWER = 32, 0.8   # documents whose topics are updated by one call, share of the topics left at which the others go
LONG = 10_000           # tokens from which a document is fitted in double precision
CHUNK, SLICE = 2_000, 500   # term rows that one call computes, documents whose terms' rows are held at once
LEAST = 1e-9           # gains below this are not stored: a draw is about 1 and rows are in single precision (6e-8)
COUNTS = "struct<indices:array<long>,values:array<int>>"


# ------------------------------------------------------------ count vectors

def counted(hashes):
    """Arrow lists of term names -> each list's distinct names, in order, and their counts."""
    import pyarrow as pa
    ends = np.append(0, np.cumsum(hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    flat, names, counts, sizes = hashes.flatten().to_numpy(zero_copy_only=False), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [0]
    for lo in range(0, len(ends) - 1, 500):
        found = [np.unique(flat[a:b], return_counts=True) for a, b in itertools.pairwise(ends[lo:lo + 501])]
        sizes += [len(x) for x, _ in found]
        names.append(np.concatenate([x for x, _ in found]))
        counts.append(np.concatenate([n for _, n in found]).astype(np.int32))
    at = pa.array(np.cumsum(sizes), pa.int32())
    pa.default_memory_pool().release_unused()
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (names, counts)], ["indices", "values"])


class Terms:
    """What ``count_vectors`` gives for its wide form: the terms stay in a table."""

    def __init__(self, df: DataFrame, col: str):
        self.df, self.col = df, col

    @property
    def table(self) -> DataFrame:
        """(at, term): a row for each document that holds the term."""
        return self.df.select(F.explode(F.array_distinct(self.col)).alias("term")).select(F.xxhash64("term").alias("at"), "term")

    @property
    def vocabulary(self) -> list:
        """All terms, gathered by the driver: for small tables."""
        n = self.df.select(F.explode(self.col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        return [r.term for r in n.orderBy(F.desc("n"), "term").collect()]


# ------------------------------------------------------------------ numbers

def digamma(x):
    inv = 1 / (x + 6)
    sq = inv * inv
    out = np.log(x + 6) - inv / 2 - sq * (1 / 12 - sq * (1 / 120 - sq * (1 / 252 - sq * (1 / 240 - sq / 132))))
    for i in range(6):
        out -= 1 / (x + i)
    return out


def trigamma(x):
    inv = 1 / (x + 6)
    sq = inv * inv
    return inv + sq / 2 + inv * sq * (1 / 6 - sq * (1 / 30 - sq * (1 / 42 - sq / 30))) + sum(1 / (x + i) ** 2 for i in range(6))


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def quantiles():
    """65,536 equally likely values of Gamma(``SHAPE``, 1 / ``SHAPE``), by Wilson and Hilferty's cube of a normal one."""
    normal = statistics.NormalDist().inv_cdf
    z = np.array([normal((i + 0.5) / 65536) for i in range(65536)])
    return ((1 - 1 / (9 * SHAPE) + z / (3 * SHAPE**0.5)) ** 3).astype(np.float32)


def draws(names, k: int, seed: int):
    """For each 64-bit name, ``k`` positions in ``quantiles``."""
    step = _mixed(np.arange(1, -(-k // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return _mixed(_mixed(names)[:, None] ^ step).view(np.uint16)[:, :k]


def drawn(rows, seed: int):
    """How often each document is in a mini-batch: Poisson draws of mean ``SHARE``."""
    u = (_mixed(_mixed(rows) ^ _mixed(np.array([seed], np.uint64))) >> np.uint64(11)) * 2.0**-53
    out, p, total = np.zeros(len(rows), int), math.exp(-SHARE), 0.0
    for i in range(1, 12):
        total += p
        out += u >= total
        p *= SHARE / i
    return out


def inferred(beta, ends, at, counts, alpha, start):
    """Variational fit of the documents of a block to the topics.

    ``beta``: a row per term; document d has the terms ``at[ends[d]:ends[d + 1]]``.
    Returns gamma and expected topics of each document (zeros for one without
    terms), and count / norm of each entry.
    """
    n, k = len(ends) - 1, len(alpha)
    gamma, theta, ratio = np.zeros((n, k)), np.zeros((n, k), np.float32), np.zeros(len(at), np.float32)
    queue = iter(np.flatnonzero(ends[1:] > ends[:-1]))
    first = np.exp(digamma(start) - digamma(start.sum()))
    docs, rows, c, cols, g, t = [], [], [], [], np.zeros((0, k)), np.zeros((0, k))   # of the documents at work

    def taken(d):
        x = counts[ends[d]:ends[d + 1]]
        kind = np.float64 if x.sum() > LONG else np.float32
        return d, beta[at[ends[d]:ends[d + 1]]].astype(kind, copy=False), x.astype(kind, copy=False), None

    while True:
        if new := [taken(d) for d in itertools.islice(queue, TOGETHER - len(docs))]:
            for known, x in zip((docs, rows, c, cols), zip(*new)):
                known.extend(x)
            g, t = np.concatenate([g, np.tile(start, (len(new), 1))]), np.concatenate([t, np.tile(first, (len(new), 1))])
        if not docs:
            return gamma, theta, ratio
        add, single = np.zeros((len(docs), k)), t.astype(np.float32)
        for i, (e, x, own) in enumerate(zip(rows, c, cols)):
            w = (single if e.dtype == np.float32 else t)[i]
            norm = e @ (w if own is None else w[own])
            norm += 1e-37
            np.divide(x, norm, out=norm)
            if own is None:
                add[i] = norm @ e
            else:
                add[i, own] = norm @ e
        last, g = g, alpha + t * add
        t = np.exp(digamma(g) - digamma(g.sum(1, keepdims=True)))
        going = np.abs(g - last).sum(1) > CHANGE * k
        if not going.all():
            for i in np.flatnonzero(~going):
                e, d = rows[i], docs[i]
                w = (t[i] if cols[i] is None else t[i, cols[i]]).astype(e.dtype)
                ratio[ends[d]:ends[d + 1]] = c[i] / (e @ w + 1e-37)
                gamma[d], theta[d] = g[i], t[i]
            docs, rows, c, cols = ([x for x, y in zip(known, going) if y] for known in (docs, rows, c, cols))
            g, t = g[going], t[going]
        left = t > DEAD
        width = left.sum(1)
        for i in np.flatnonzero(width <= FEWER * np.array([e.shape[1] for e in rows])):
            own = np.flatnonzero(left[i])
            rows[i] = np.ascontiguousarray(rows[i][:, own if cols[i] is None else np.isin(cols[i], own)])
            cols[i] = own


# ------------------------------------------------------- blocks and parts

def _spans(ends, take):
    """Positions of the entries of the documents ``take``, and where each of them ends."""
    n = (ends[1:] - ends[:-1])[take]
    to = np.append(0, np.cumsum(n))
    return np.repeat(ends[:-1][take] - to[:-1], n) + np.arange(to[-1]), to


def _block(batches):
    """A partition's documents: row numbers, ends, term positions, counts, and the terms' names in order."""
    rows, sizes, names, counts = [], [], [], []
    for b in batches:
        rows.append(b.column(0).to_numpy(zero_copy_only=False))
        sizes.append(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        names.append(b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        counts.append(b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32))
    join = lambda x, kind: x[0].astype(kind, copy=False) if len(x) == 1 else np.concatenate([np.zeros(0, kind), *x])
    vocab, at = np.unique(join(names, np.uint64), return_inverse=True)
    return join(rows, np.int64), np.append(0, np.cumsum(join(sizes, np.int64))), at.astype(np.int32), join(counts, np.float32), vocab


def _batch(block, seed: int):
    """A mini-batch's documents in a block: terms' names, ends, entries' terms, counts, times drawn."""
    row, ends, at, counts, vocab = block
    times = drawn(row.view(np.uint64), seed)
    take = np.flatnonzero((times > 0) & (ends[1:] > ends[:-1]))
    entries, to = _spans(ends, take)
    own, local = np.unique(at[entries], return_inverse=True)
    return vocab[own], to, local, counts[entries], times[take].astype(np.float32)


def _pack(batches):
    """mapInArrow body: a partition's block, pickled into one row."""
    import pyarrow as pa
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_block(batches), 5)], pa.binary())], ["block"])


def _single(rdd):
    """Each element pickled by itself, as ``zip`` wants it: else it sends both sides through Python workers of its own."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _kept(rdd):
    return _single(rdd).persist(StorageLevel.MEMORY_AND_DISK)


def _gathered(pairs, n: int):
    """Pairs (number below ``n``, x) -> one list of x a partition, in the order of their senders."""
    return _single(pairs.partitionBy(n, int).mapPartitions(lambda it: [sorted((x for _, x in it), key=lambda x: x[0])]))


def _beside(rdd, lists):
    """Elements of ``rdd`` with those of ``lists`` (``_gathered``), which may have been dealt to more partitions than asked."""
    if more := lists.getNumPartitions() - rdd.getNumPartitions():
        rdd = rdd.union(_single(rdd.ctx.parallelize([None] * more, more)))
    return rdd.zip(lists).filter(lambda x: x[0] is not None)


def _by_part(sender: int, names, parts: int):
    """(part, (sender, positions among ``names``, names)) for each part."""
    part = names % np.uint64(parts)
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p).astype(np.int32)
        yield p, (sender, at, names[at])


def _forget(rdd) -> None:
    """Free the files of the shuffle that ``rdd`` reads; Spark writes them again if a lost part needs them."""
    cleaner, todo = rdd.ctx._jsc.sc().cleaner(), [rdd._jrdd.rdd()]
    while todo and cleaner.isDefined():
        deps = todo.pop().dependencies()
        for d in (deps.apply(i) for i in range(deps.size())):
            if d.getClass().getSimpleName() == "ShuffleDependency":
                cleaner.get().doCleanupShuffle(d.shuffleId(), False)
            else:
                todo.append(d.rdd())


class WideTopics:
    """A fitted model: the parts' gains (``state``), and in the driver the sums and the prior of each topic.

    A part is (names in order, where each name's gains end, their topics, their values).
    """

    def __init__(self, docs: DataFrame, col: str, k: int, max_iter: int, seed: int):
        sc = docs.sparkSession.sparkContext
        ship_library(docs.sparkSession)
        self.k, self.seed, self.eta, self.alpha = k, seed, 1.0 / k, np.full(k, 1.0 / k)
        self.n = docs.count()
        self.docs, self.col = docs.coalesce(max(sc.defaultParallelism, -(-self.n // DOCS_PER_BLOCK))), col
        self.parts = max(sc.defaultParallelism, -(-self.n // (DOCS_PER_BLOCK * BLOCKS_PER_PART)))
        self.scale, self.shift, self.done = 1.0, 0.0, None
        self.start = quantiles()[draws(np.array([seed], np.uint64), k, seed + 1)[0]].astype(float)
        self._begin()
        for i in range(max_iter):
            self._step(i)

    def _begin(self) -> None:
        k, seed = self.k, self.seed

        kind = self.kind = np.uint8 if k <= 256 else np.uint16
        rows = self.docs.select("_row", F.col(self.col)["indices"].alias("i"), F.col(self.col)["values"].alias("v"))
        self.blocks = _kept(rows.mapInArrow(_pack, "block binary").rdd.map(lambda r: pickle.loads(r.block)))

        def first(asked):
            names = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in asked)]))
            return names, np.zeros(len(names) + 1, np.int64), np.zeros(0, kind), np.zeros(0, np.float32)

        def total(part):
            names, out = part[0], np.zeros(k)
            for j in range(0, len(names), CHUNK):
                out += quantiles()[draws(names[j:j + CHUNK], k, seed)].sum(0, dtype=float)
            return out, len(names)

        self.state = _kept(self._asked(self.blocks.map(lambda block: block[-1])).map(first))
        sums = self.state.map(total).collect()
        self.sums, self.n_terms = sum(x for x, _ in sums), sum(m for _, m in sums)

    def _asked(self, names):
        """For each part, the terms that the blocks name."""
        parts = self.parts
        return _gathered(names.mapPartitionsWithIndex(lambda b, it: (x for own in it for x in _by_part(b, own, parts))), parts)

    def _answers(self, names):
        """For each block, the gains of the terms that it names: positions of the terms, topics, values."""
        def answer(p, it):
            for (names, ends, topic, gain), asked in it:
                for b, at, wanted in asked:
                    own = np.searchsorted(names, wanted)
                    entries, to = _spans(ends, own)
                    sizes = np.diff(to)
                    yield b, (p, at[sizes > 0], sizes[sizes > 0].astype(np.uint16), topic[entries], gain[entries])

        return _gathered(_beside(self.state, self._asked(names)).mapPartitionsWithIndex(answer), self.blocks.getNumPartitions())

    def _rows(self):
        """A function of term names and their gains: exp of the expected log of each topic's share in each term."""
        k, seed, scale, shift = self.k, self.seed, self.scale, self.shift
        by_topic = np.exp(-digamma(self.sums)).astype(np.float32)

        def rows(names, at, topic, gain):
            """``at`` in order."""
            weight = quantiles() * scale + shift
            plain, out = np.exp(digamma(weight)).astype(np.float32), np.empty((len(names), k), np.float32)
            for j in range(0, len(names), CHUNK):
                x, own = draws(names[j:j + CHUNK], k, seed), slice(*np.searchsorted(at, [j, j + CHUNK]))
                out[j:j + CHUNK] = plain[x]
                out[at[own], topic[own]] = np.exp(digamma(weight[x[at[own] - j, topic[own]]] + scale * gain[own]))
            return out * by_topic

        return rows

    def _fitter(self):
        """A function of a block's documents and its answers: for each slice of documents (first, last, terms, entries' terms, rows, fit)."""
        alpha, start, rows = self.alpha, self.start, self._rows()

        def fitted(names, ends, at, counts, answers):
            none = np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.float32)
            term, topic, gain = (np.concatenate(x) for x in zip(none, *((np.repeat(at, sizes), *x) for _p, at, sizes, *x in answers)))
            order = np.argsort(term, kind="stable")
            term, topic, gain = term[order], topic[order], gain[order]
            to_term = np.searchsorted(term, np.arange(len(names) + 1))
            for lo in range(0, len(ends) - 1, SLICE):
                hi = min(lo + SLICE, len(ends) - 1)
                own, local = np.unique(at[ends[lo]:ends[hi]], return_inverse=True)
                entries, to = _spans(to_term, own)
                beta = rows(names[own], np.repeat(np.arange(len(own)), np.diff(to)), topic[entries], gain[entries])
                yield lo, hi, own, local, beta, inferred(beta, ends[lo:hi + 1] - ends[lo], local, counts[ends[lo]:ends[hi]], alpha, start)

        return fitted

    def _step(self, i: int) -> None:
        k, kind, parts, fitter, seed = self.k, self.kind, self.parts, self._fitter(), self.seed + 2 + i
        rho = (OFFSET + i + 1) ** -DECAY
        grown, scale = self.n / np.ceil(SHARE * self.n), self.scale * (1 - rho)
        least = LEAST * scale / (rho * grown)

        def fitted(b, it):
            for (names, ends, at, counts, times), answers in it:
                total, logs, found = np.zeros(k), np.zeros(k), []
                for lo, hi, own, local, beta, (gamma, theta, ratio) in fitter(names, ends, at, counts, answers):
                    doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1]))
                    logs += (times[lo:hi, None] * (digamma(gamma) - digamma(gamma.sum(1, keepdims=True)))).sum(0)
                    order = np.argsort(local, kind="stable")
                    doc, ratio = doc[order], (ratio * times[lo + doc])[order]
                    first = np.searchsorted(local[order], np.arange(len(own) + 1))
                    for j in range(0, len(own), CHUNK):
                        cut = first[j:j + CHUNK + 1]
                        e = slice(cut[0], cut[-1])
                        add = np.add.reduceat(ratio[e, None] * theta[doc[e]], cut[:-1] - cut[0]) * beta[j:j + CHUNK]
                        total += add.sum(0, dtype=float)
                        row, topic = np.nonzero(add > least)
                        found.append((own[j + row], topic.astype(kind), add[row, topic]))
                yield -1, (b, total, logs, times.sum(dtype=float))
                if found:
                    term, topic, add = (np.concatenate(x) for x in zip(*found))
                    part = names[term] % np.uint64(parts)
                    for p in np.unique(part).tolist():
                        e = np.flatnonzero(part == p)
                        first = np.flatnonzero(np.diff(term[e], prepend=-1))
                        yield p, (b, names[term[e[first]]], np.diff(first, append=len(e)).astype(np.uint16), topic[e], add[e])

        batch = _kept(self.blocks.map(lambda block: _batch(block, seed)))
        answers = self._answers(batch.map(lambda x: x[0]))
        sent = _beside(batch, answers).mapPartitionsWithIndex(fitted).persist(StorageLevel.MEMORY_AND_DISK)
        told = sorted(sent.filter(lambda x: x[0] < 0).values().collect(), key=lambda x: x[0])
        _forget(answers)
        batch.unpersist()
        total, logs, n = (sum(x[j] for x in told) for j in (1, 2, 3))
        if n:
            self._settle()
            share = np.float32(rho * grown / scale)

            def moved(pair):
                (names, ends, topic, gain), got = pair
                term = np.concatenate([np.repeat(np.arange(len(names)), np.diff(ends)), *(np.repeat(np.searchsorted(names, x[1]), x[2]) for x in got)])
                key = term * k + np.concatenate([topic, *(x[3] for x in got)])
                value = np.concatenate([gain, *(x[4] * share for x in got)])
                order = np.argsort(key, kind="stable")
                key, first = np.unique(key[order], return_index=True)
                value = np.add.reduceat(value[order], first) if len(key) else value
                return names, np.searchsorted(key, np.arange(len(names) + 1) * k), (key % k).astype(kind), value

            stats = _gathered(sent.filter(lambda x: x[0] >= 0), parts)
            self.done = (self.state, stats, sent)
            self.state = _kept(_beside(self.state, stats).map(moved))
            self.sums = (1 - rho) * self.sums + rho * (self.n_terms * self.eta + grown * total)
            self.scale, self.shift = scale, self.shift * (1 - rho) + rho * self.eta
            self._prior(logs / n, n, rho)

    def _settle(self) -> None:
        """The state is stored by now: frees what it was made of."""
        if self.done:
            state, stats, sent = self.done
            state.unpersist()
            sent.unpersist()
            _forget(stats)
            self.done = None

    def _prior(self, logs, n: float, rho: float) -> None:
        """Newton step of Huang's for the prior of the topics."""
        a = self.alpha
        grad = n * (digamma(a.sum()) - digamma(a) + logs)
        c, q = n * trigamma(a.sum()), -n * trigamma(a)
        b = (grad / q).sum() / (1 / c + (1 / q).sum())
        new = a - rho * (grad - b) / q
        if (new > 0).all():
            self.alpha = new

    def transform(self, out: str) -> DataFrame:
        """The documents with their topic mixture, a vector of zeros for one without terms."""
        from pyspark.ml.functions import array_to_vector
        fitter, k = self._fitter(), self.k

        def mixed(pair):
            (row, ends, at, counts, vocab), answers = pair
            share = np.concatenate([np.zeros((0, k)), *(x[-1][0] for x in fitter(vocab, ends, at, counts, answers))])
            share /= np.where(total := share.sum(1, keepdims=True), total, 1.0)
            return bytearray(row.tobytes()), bytearray(share.tobytes())

        def unpacked(batches):
            import pyarrow as pa
            for b in batches:
                for row, share in zip(b.column(0), b.column(1)):
                    row, share = (np.frombuffer(x.as_buffer(), t) for x, t in ((row, np.int64), (share, float)))
                    for j in range(0, len(row), CHUNK):
                        own = row[j:j + CHUNK]
                        ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * k)
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(ends, pa.array(share[j * k:(j + len(own)) * k]))], ["_row", "_share"])

        got = _beside(self.blocks, self._answers(self.blocks.map(lambda block: block[-1]))).map(mixed)
        table = self.docs.sparkSession.createDataFrame(got, "row binary, share binary").mapInArrow(unpacked, "_row long, _share array<double>")
        return self.docs.join(table, "_row").withColumn(out, array_to_vector("_share")).drop("_row", "_share")

    def strongest(self, n: int | None) -> DataFrame:
        """(topic, at, weight): the ``n`` strongest terms of each topic (None: all); weights of a topic's terms sum to 1."""
        k, seed, scale, shift, sums = self.k, self.seed, self.scale, self.shift, self.sums

        def found(part):
            names, ends, topic, gain = part
            best, w = [np.zeros(0, np.uint64)] * k, [np.zeros(0)] * k
            for j in range(0, len(names), CHUNK):
                own, cut = names[j:j + CHUNK], ends[j:j + CHUNK + 1]
                x, e = quantiles()[draws(own, k, seed)].astype(float), slice(cut[0], cut[-1])
                x[np.repeat(np.arange(len(own)), np.diff(cut)), topic[e]] += gain[e]
                x = (x * scale + shift) / sums
                for t in range(k):
                    both, name = np.append(w[t], x[:, t]), np.append(best[t], own)
                    top = np.lexsort((name, -both))[:n]
                    best[t], w[t] = name[top], both[top]
            return [(t, int(a), float(b)) for t in range(k) for a, b in zip(best[t].view(np.int64), w[t])]

        rows, spark = self.state.flatMap(found), self.docs.sparkSession
        if n is not None:       # what the parts name is at most n terms a topic and part
            rows = sorted(rows.collect(), key=lambda r: (r[0], -r[2], r[1]))
            rows = [r for i, r in enumerate(rows) if i < n or rows[i - n][0] != r[0]]
        return spark.createDataFrame(rows, "topic int, at long, weight double")


def fit(df: DataFrame, col: str, k: int, max_iter: int, seed: int, out: str):
    """(model, ``df`` with its topics): the count vectors are written once and read from the shared folder."""
    docs = save_intermediate(df.withColumn("_row", F.monotonically_increasing_id()), "topic-docs", maxRecordsPerFile=DOCS_PER_BLOCK // 4)
    model = WideTopics(docs, col, k, max_iter, seed)
    return model, model.transform(out)
