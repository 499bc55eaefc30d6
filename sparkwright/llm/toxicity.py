"""Toxicity: Levenshtein automata intersected with a lexicon trie, and
context windows that tell quotation from abuse.

The lexicon is learned from labelled documents: whole words and word stems
that occur in toxic ones only, chosen greedily by the toxic documents they
add. A document's word is then looked up with its Levenshtein automaton in
tries of the lexicon, so misspelled terms are found too: swapped neighbours
are one edit, long terms may have two, stems match beginnings, and digits and
symbols inside a word belong to it. Each hit is weighed
by its context window, and a logistic model turns the weights into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import crc_of_id, ship

WORD = re.compile(r"[^\W\d_]+")
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)  # stems are written with a trailing *
# A word with digits or symbols in it or at its ends; what it is cut into by WORD is looked up as well.
TOKEN = re.compile(r"[\d*@$]*+[^\W\d_]++(?:[\d_*@$!|#%&+'’.-]{1,2}[^\W\d_]++)*+[\d*@$]*+")
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
SEPARATOR = str.maketrans("", "", "_+'’.-")
FUZZY_FROM, TWO_FROM = 4, 8  # terms and stems of at least so many letters match at one edit, at two
FIRM_FROM = 5             # shorter terms and all stems are faint when misspelled
CONTEXT_WORDS = 6
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
MAX_SAMPLE = 12_000       # labelled documents used for fitting, at most
MIN_DOCS, MIN_PURITY, CLEAN_COST = 4, 0.6, 1
MEASURES = ("word", "stem", "misspelled", "faint", "quoted", "density")
PRIOR_WEIGHTS = (2.5, 1.5, 1.5, 1.5, 0.5, 0.5)  # what the ridge pulls the measures' weights to


class Automaton:
    """Levenshtein automaton of ``word`` for ``k`` edits; a state is the sparse
    row of (position, edits) pairs that can still lead to acceptance.

    With ``swaps`` two neighbours in the wrong order are one edit; position
    -1 - i then stands for i with the letter after it read first.
    """

    def __init__(self, word: str, k: int, swaps: bool = False):
        self.word, self.k, self.swaps = word, k, swaps

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state: tuple, letter: str) -> tuple:
        best: dict[int, int] = {}
        for i, e in state:
            if i < 0:
                if self.word[-1 - i] == letter:
                    best[1 - i] = min(best.get(1 - i, self.k), e)              # -1 - i + 2
                continue
            if e < self.k:
                best[i] = min(best.get(i, self.k), e + 1)                      # letter inserted
            for skip in range(self.k - e + 1):                                 # word letters left out
                j = i + skip
                if j >= len(self.word):
                    break
                cost = e + skip + (self.word[j] != letter)
                if cost <= self.k:
                    best[j + 1] = min(best.get(j + 1, self.k), cost)
                if self.swaps and e + skip < self.k and self.word[j + 1:j + 2] == letter:
                    best[-1 - j] = min(best.get(-1 - j, self.k), e + skip + 1)
        return tuple(best.items())

    def accepts(self, state: tuple) -> bool:
        return any(i >= 0 and len(self.word) - i + e <= self.k for i, e in state)

    def begins(self, state: tuple) -> bool:
        """What was read is within ``k`` edits of a beginning of the word that leaves a letter."""
        return any(0 <= i < len(self.word) for i, _ in state)


class Trie:
    """Trie of terms as nested dictionaries; the empty key holds the term."""

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for letter in t:
                node = node.setdefault(letter, {})
            node[""] = t

    def near(self, word: str, k: int, swaps: bool = False, begins: bool = False) -> str | None:
        """A term within ``k`` edits of ``word`` (``begins``: of a beginning of it): the automaton and the trie walked together."""
        a = Automaton(word, k, swaps)
        good = a.begins if begins else a.accepts
        stack = [(self.root, a.start())]
        while stack:
            node, state = stack.pop()
            if "" in node and good(state):
                return node[""]
            for letter, below in node.items():
                if letter and (after := a.step(state, letter)):
                    stack.append((below, after))
        return None


def deletions(word: str, k: int) -> set:
    """``word`` with up to ``k`` letters left out."""
    out = last = {word}
    for _ in range(k):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


class Near:
    """Terms that are found within ``k`` edits, or stems found so at the beginning of a word."""

    def __init__(self, terms: list[str], k: int, begins: bool, kind: int):
        self.trie, self.k, self.begins, self.kind = Trie(terms), k, begins, kind
        # Two words within k edits have a common rest with at most k letters of each left out:
        # a word that has none with any term is not looked up.
        self.rests = {d for t in terms for d in deletions(t, k)}
        # Of k + 1 pieces of a term, k edits leave one as it was and move it by k places at most; a swap
        # over a cut changes two pieces in a way known beforehand. Looked at first, as it is cheaper.
        places: dict[tuple[int, int], set] = {}
        for t in terms:
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            for v in (t, *(t[:c - 1] + t[c] + t[c - 1] + t[c + 1:] for c in cuts[1:-1])):
                for a, b in zip(cuts, cuts[1:]):
                    for at in range(max(a - k, 0), a + k + 1) if a else (0,):
                        places.setdefault((at, at + b - a), set()).add(v[a:b])
        self.places = [(a, b, found) for (a, b), found in sorted(places.items())]
        self.shortest = min(map(len, terms), default=1) - k
        self.longest = max(map(len, terms), default=0) + k

    def finds(self, word: str) -> bool:
        if not self.rests or len(word) < self.shortest or (len(word) > self.longest and not self.begins):
            return False
        if not any(word[a:b] in found for a, b, found in self.places):
            return False
        lengths = range(self.shortest, min(self.longest, len(word)) + 1) if self.begins else (len(word),)
        return any(not self.rests.isdisjoint(deletions(word[:n], self.k)) for n in lengths) \
            and self.trie.near(word, self.k, True, self.begins) is not None


@dataclass
class Lexicon:
    """Terms, stems and the clean words that are near a term by chance."""

    words: frozenset
    stems: frozenset
    clean: frozenset = frozenset()
    seen: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.stem_lengths = sorted({len(s) for s in self.stems})
        self.near = [Near([t for t in terms if a <= len(t) < b], k, begins, kind) for terms, a, b, k, begins, kind in (
            (self.words, FIRM_FROM, TWO_FROM, 1, False, 3), (self.words, TWO_FROM, math.inf, 2, False, 3),
            (self.words, FUZZY_FROM, FIRM_FROM, 1, False, 4),
            (self.stems, FUZZY_FROM, TWO_FROM, 1, True, 4), (self.stems, TWO_FROM, math.inf, 2, True, 4))]

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "clean": self.clean}

    def __setstate__(self, state):
        self.__init__(**state)

    def exact(self, word: str) -> int:
        """1 a term, 2 a word with a stem, 0 neither."""
        if word in self.words:
            return 1
        return 2 if any(word[:n] in self.stems for n in self.stem_lengths if n < len(word)) else 0

    def kind(self, word: str) -> int:
        """0 no hit, 1 a term, 2 a stem, 3 a misspelled term, 4 a misspelled short term or stem."""
        plain = WORD.fullmatch(word)
        if plain and (k := self.exact(word)):
            return k
        if word in self.clean:
            return 0
        if not plain:
            joined = word.translate(SEPARATOR)
            word = joined.translate(LOOKALIKE)
            if self.exact(word):
                return 3
            if WORD.fullmatch(joined):     # nothing but separators: whole words side by side as a rule
                return 0
        return next((n.kind for n in self.near if n.finds(word)), 0)

    def hits(self, words: set) -> dict:
        """Kinds of the words that are hits; kinds are kept, at most 200,000 of them."""
        if len(self.seen) > 200_000:
            self.seen.clear()
        for w in words.difference(self.seen):
            self.seen[w] = self.kind(w)
        return {w: k for w in words if (k := self.seen[w])}


def quoted(text: str, start: int, end: int) -> bool:
    """A quotation mark opens within ``CONTEXT_WORDS`` words before the hit and closes within as many after it."""
    before, after = text[max(0, start - 200):start], text[end:end + 200]
    before = "".join(re.split(r"(\s+)", before)[-2 * CONTEXT_WORDS:])
    after = "".join(re.split(r"(\s+)", after)[:2 * CONTEXT_WORDS])
    opened = max((before.rfind(c) for c in OPENING), default=-1)
    if opened < 0 or sum(before[opened:].count(c) for c in '"') > 1:
        return False
    return any(c in after for c in CLOSING)


def mixed_tokens(low: str) -> set:
    """Distinct words of a lower-cased text that have digits or symbols in them."""
    return {t for t in set(TOKEN.findall(low)) if not WORD.fullmatch(t)}


def features(text: str, lexicon: Lexicon, misspelled: bool = False) -> tuple[float, ...]:
    """The ``MEASURES``: log(1 + n) of hits on words, on stems, misspelled, faintly so, quoted, and of all hits a thousand words.

    With ``misspelled`` they are those of the text with all its terms misspelled.
    """
    low = text.lower()
    words = WORD.findall(low)
    mixed = mixed_tokens(low)
    hits = lexicon.hits(mixed.union(words))
    if not hits:
        return (0.0,) * len(MEASURES)
    n = [0, 0, 0, 0, 0]
    marks = any(c in low for c in OPENING)
    found = [m for m in WORD.finditer(low) if m.group() in hits]
    if not mixed.isdisjoint(hits):
        taken = {m.start() for m in found}
        found += [m for m in TOKEN.finditer(low) if m.group() in mixed and m.group() in hits and taken.isdisjoint(range(*m.span()))]
    for m in found:
        k = hits[m.group()]
        if misspelled and k <= 2:
            k = 3 if k == 1 and len(m.group()) >= FIRM_FROM else 4
        n[4 if marks and quoted(low, m.start(), m.end()) else k - 1] += 1
    return (*(math.log1p(x) for x in n), math.log1p(1000 * sum(n[:4]) / (len(words) + 20)))


@dataclass
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]  # intercept, then one for each measure

    def score(self, text: str | None) -> float:
        x = features(text or "", self.lexicon)
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 50,
             weight: np.ndarray | None = None) -> np.ndarray:
    """Newton fit of a logistic model with a free intercept and a ridge towards ``prior``; rows may have weights."""
    r = np.ones(len(x)) if weight is None else weight
    a = np.column_stack([np.ones(len(x)), x])
    centre, pull = np.append(0.0, prior), np.append(1e-3, np.full(len(prior), ridge))
    w = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (r * (y - p)) - pull * (w - centre)
        step = np.linalg.solve((a * (r * p * (1 - p))[:, None]).T @ a + np.diag(pull), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, max_sample: int) -> DataFrame:
    """(toxic, text) of distinct labelled training texts, at most about ``max_sample``.

    ``train`` is a condition on ``doc_id``. Which documents are taken depends
    on a hash of their id only.
    """
    seen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(train) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = max(1, -(-seen.count() // max_sample))
    seen = seen.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    # The ids are at most about max_sample, so the broadcast is bounded.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(seen), "doc_id")
    return cut_lineage(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))


def _doc_features(text: str) -> set:
    words = set(WORD.findall(text.lower()))
    return {w for w in words if len(w) > 2}.union(
        w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n)


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n = {0: Counter(), 1: Counter()}
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            n[int(toxic > 0)].update(_doc_features(text))
        names = list(n[0] | n[1])
        yield pd.DataFrame({"feature": pd.Series(names, dtype=object), "toxic": [n[1][f] for f in names], "clean": [n[0][f] for f in names]})


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Greedy cover of the toxic sample documents by pure terms and stems.

    A term counts by the documents that no chosen term covers yet (a clean one
    against it), so the words that copies of one text share are not taken for
    terms. Of terms that cover the same documents the longest is chosen.
    """
    counts = sample.mapInPandas(_count_features, "feature string, toxic long, clean long") \
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")) \
        .where((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= MIN_PURITY * (F.col("toxic") + F.col("clean"))))
    pure = frozenset(r.feature for r in counts.collect())

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sorted(_doc_features(t) & pure) for t in pdf["text"]]
            some = [bool(f) for f in found]
            yield pd.DataFrame({"toxic": pdf["toxic"].to_numpy()[some].astype("int32"), "found": pd.Series([f for f in found if f], dtype=object)})

    # Bounded by the sample: the pure terms of each of its documents.
    rows = sample.mapInPandas(matched, "toxic int, found array<string>").collect()
    n_toxic = sum(r.toxic > 0 for r in rows)
    toxic: dict[str, set] = {}
    clean: dict[str, set] = {}
    for i, r in enumerate(rows):
        for f in r.found:
            (toxic if r.toxic > 0 else clean).setdefault(f, set()).add(i)
    often = {t: len(c) for t, c in toxic.items() if not t.endswith("*") and t not in clean}
    words, stems = set(), set()
    gain = lambda t: len(toxic[t]) - CLEAN_COST * len(clean.get(t, ()))
    while toxic:
        f = max(toxic, key=lambda t: (gain(t), len(t), t))
        if gain(f) < max(MIN_DOCS, 0.003 * n_toxic):
            break
        (stems if f.endswith("*") else words).add(f.rstrip("*"))
        done, against = toxic[f], clean.get(f, set())
        toxic = {t: left for t, c in toxic.items() if (left := c - done)}
        clean = {t: left for t, c in clean.items() if (left := c - against)}
    # Terms that a chosen one mostly occurs together with add few documents of
    # their own: whole words that no clean document holds, about as common.
    return Lexicon(frozenset(words | {t for t, n in often.items() if n >= max(2 * MIN_DOCS, 0.05 * n_toxic)}),
                   frozenset(stems))


def half(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_sample: int = MAX_SAMPLE) -> Model:
    """Learn lexicon and weights from labelled documents.

    At most about ``max_sample`` labelled texts are used, picked by a hash of
    the id; all collected data is bounded by that parameter. Without toxic or
    without clean labels the lexicon is empty and every score is the label's
    share (0 where nothing is labelled).
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, F.lit(True) if train is None else train, max_sample)
    lexicon = learn_lexicon(sample)

    def near_clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [(w, half(t)) for t in pdf["text"] for w in mixed_tokens(t.lower()).union(WORD.findall(t.lower()))]
            near = lexicon.hits({w for w, _ in words})
            rows = sorted({(w, h) for w, h in words if near.get(w, 0) >= 3})
            yield pd.DataFrame({"word": pd.Series([w for w, _ in rows], dtype=object), "half": pd.Series([h for _, h in rows], dtype="int32")})

    clean = sample.where("toxic = 0").mapInPandas(near_clean, "word string, half int").distinct().collect()
    # Clean texts are measured with the clean words of the other half, so that the weights
    # know how often a word that no fitted text holds is near a term by chance.
    others = [Lexicon(lexicon.words, lexicon.stems, frozenset(r.word for r in clean if r.half != h)) for h in (0, 1)]
    lexicon = Lexicon(lexicon.words, lexicon.stems, frozenset(r.word for r in clean))

    # The lexicon is learned from spellings as they are, so fitted texts hardly have misspelled
    # terms; each text is measured a second time as if all its terms were.
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for misspelled in (False, True):
                x = [features(t, lexicon if toxic > 0 else others[half(t)], misspelled) for t, toxic in zip(pdf["text"], pdf["toxic"])]
                yield pd.DataFrame(x, columns=MEASURES).assign(y=(pdf["toxic"] > 0).astype("float64").to_numpy())

    seen = sample.mapInPandas(measured, ", ".join(f"{c} double" for c in (*MEASURES, "y"))).toPandas()
    prior = np.asarray(PRIOR_WEIGHTS)
    if seen.empty or seen["y"].nunique() < 2:
        share = float(seen["y"].mean()) if len(seen) else 0.0
        return Model(Lexicon(frozenset(), frozenset()), (math.log((share + 1e-9) / (1 - share + 1e-9)), *PRIOR_WEIGHTS))
    return Model(lexicon, tuple(logistic(seen[list(MEASURES)].to_numpy(), seen["y"].to_numpy(), prior)))


def score_column(text: Column, model: Model) -> Column:
    """Toxicity score (0 to 1) of a text column; a null text scores as the empty one."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")
    return score(F.coalesce(text, F.lit("")))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: CRC-32 of the id's text leaves 2 modulo 4."""
    return crc_of_id(id_col) % 4 == 2


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns only from labelled rows that are not held out; the score reads the
    text alone, whole. Null and empty texts get the score of a text without
    hits; a null id is not held out; repeated rows score alike; labels that
    are null, repeated (the largest counts) or of unknown ids do no harm.
    """
    model = fit(docs, labels, ~held_out())
    return docs.select("doc_id", held_out().alias("held_out"), score_column(F.col("text"), model).alias("score")) \
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, all columns unchanged."""
    model = fit(docs, labels, ~held_out())
    return docs.where(score_column(F.col("text"), model) < threshold)
