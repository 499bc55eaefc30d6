"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements
and one failure bit per rule. Policies are versioned sets of rules applied to
the stored bits, so a new policy or an ablation never reads the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _window_hashes(words: Column) -> Column:
    """Hash of the ``WINDOW`` words from each start (none for shorter texts)."""
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Windows sorted by (hash, start): one equal to a neighbour is repeated.
    Their starts, sorted, cover min(gap, WINDOW) words each, the last WINDOW.
    """
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = let(by_hash, lambda s: F.array_sort(F.transform(
        F.filter(F.transform(s, lambda x, j: F.struct(
            x["i"].alias("i"),
            (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
             | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))).alias("twice"))), lambda x: x["twice"]),
        lambda x: x["i"])))
    return let(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda a, x: a + x))


def repeated_words(words: Column) -> Column:
    """Words (first occurrence included) in ``WINDOW``-word windows found twice or more in the text."""
    return let(_window_hashes(words), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def _count(words: Column, test) -> Column:
    return F.size(F.filter(words, test)).cast("long")


def measures(text: Column) -> Column:
    """All measurements of a text as one struct; a null or empty text has none of anything."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        _count(w, lambda x, i: x == F.get(w, i - 1)).alias("n_stuttered"),
        _count(w, lambda x: (x == F.upper(x)) & (x != F.lower(x))).alias("n_shouted")))


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails(m)`` holds for the measures struct ``m``; its place in the rule list is its bit."""

    name: str
    fails: object


# Order is the bit order: append only, so stored ledgers keep their meaning.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30),
    Rule("symbols", lambda m: m["n_symbols"] * 100 > m["word_chars"] * 5),
    Rule("stutter", lambda m: m["n_stuttered"] * 100 > m["n_words"] * 30),
    Rule("shouting", lambda m: m["n_shouted"] * 100 > m["n_words"] * 50),
    Rule("duplicate_lines", lambda m: m["n_dup_lines"] * 100 > m["n_words"] * 10),
)


@dataclass(frozen=True)
class Policy:
    """A version of the keep rule: a document stays when none of ``rules`` failed."""

    name: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        places = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << places[n] for n in set(self.rules))


BASE = Policy("base-1", ("few_words", "repeated_windows"))
# Duplicate lines are recorded but not judged: clean documents quote a line twice.
PRODUCTION = Policy("web-1", ("few_words", "repeated_windows", "symbols", "stutter", "shouting"))


def failure_bits(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(r.fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def entry(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Ledger entry of a text: struct of ``m`` (measures) and ``bits`` (bit i set: rule i failed)."""
    return let(measures(text), lambda m: F.struct(m.alias("m"), failure_bits(m, rules).alias("bits")))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``df``: doc_id, the measures, ``bits``.

    Works row by row: no shuffle, memory for one text at a time. Null and
    empty texts have zero measures and fail ``few_words``; a null id stays
    null; repeated rows are judged alike; other columns are not read.
    """
    row = df.select(F.col(id_col).alias("doc_id"), entry(F.col(text_col), rules).alias("e"))
    return row.select("doc_id", "e.m.*", "e.bits")


def passes(bits: Column, policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where none of the policy's rules failed."""
    return bits.bitwiseAND(F.lit(policy.mask(rules))) == 0


def keep(docs: DataFrame, text_col: str = "text", policy: Policy = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, all columns unchanged."""
    return docs.where(passes(entry(F.col(text_col))["bits"], policy))


def ablations(ledger_df: DataFrame, policy: Policy = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: documents it fails, those that it alone
    fails, and what the policy would keep without it. One pass of bitwise
    aggregation over the stored bits."""
    places = {r.name: i for i, r in enumerate(rules)}
    full = policy.mask(rules)
    bits = F.col("bits")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for n in policy.rules:
        b = 1 << places[n]
        aggs += [F.count_if(bits.bitwiseAND(b) != 0).alias(f"_f_{n}"),
                 F.count_if(bits.bitwiseAND(full) == b).alias(f"_o_{n}"),
                 F.count_if(bits.bitwiseAND(full & ~b) == 0).alias(f"_k_{n}")]
    row = ledger_df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(policy.name).alias("policy"), F.lit(n).alias("rule"), F.col("_n").alias("n_docs"),
        F.col(f"_f_{n}").alias("n_failed"), F.col(f"_o_{n}").alias("n_failed_alone"),
        F.col(f"_k_{n}").alias("n_kept_without")) for n in policy.rules])))
