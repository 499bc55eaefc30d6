from __future__ import annotations

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from sparkwright.operators import text as T
from sparkwright.operators import tune
from sparkwright.sources import io


@pytest.fixture(scope="module")
def points(spark):
    rows = [(float(i % 7), float((i * 37) % 11), float((i % 7) + ((i * 37) % 11) / 3 + (i * 13 % 5) > 7), i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "a double, b double, label double, fold int")
    from sparkwright.operators import features as X
    return X.assemble(["a", "b"]).transform(df).cache()


def _build(p):
    return LogisticRegression(maxIter=int(p["maxIter"]), regParam=p["reg"])


SPACE = {"reg": ("logfloat", 1e-4, 50.0)}


def test_halving_goes_on_with_the_best(points):
    best, score, rows = tune.halving_search(_build, SPACE, points, "fold", n_trials=9, eta=3, least=1, most=9, seed=3, width=4)
    rungs = {}
    for r in rows:
        rungs.setdefault(r[1], []).append(r)
    assert [len(rungs[k]) for k in sorted(rungs)] == [9, 3]
    assert [rungs[k][0][2:4] for k in sorted(rungs)] == [(1, 1), (3, 3)]
    first = sorted(rungs[0], key=lambda r: (-r[4], r[0]))
    assert {r[0] for r in rungs[1]} == {r[0] for r in first[:3]}
    top = max(rungs[1], key=lambda r: r[4])
    assert (best, score) == (top[5], top[4])


def test_halving_against_the_full_search(points):
    """Its winner ranks among the first third of all draws at the full budget."""
    _b, score, rows = tune.halving_search(_build, SPACE, points, "fold", n_trials=9, least=3, most=9, seed=5, width=4)
    full = tune.random_search(lambda p: _build({**p, "maxIter": 9}), SPACE, points, "fold", n_trials=9, seed=5)[2]
    draws = [t[0] for t in full]
    assert draws == [r[5] for r in rows[:9]]        # the same draws
    winner = next(r for r in rows if r[1] == rows[-1][1] and r[4] == score)
    mean = full[draws.index(winner[5])][1]
    assert sum(t[1] > mean for t in full) < 3


def fold_by_hand(tokens, lexicon, shifters, marks):
    s, k, sub, signs = 0.0, 0, 0.0, []
    for i, w in enumerate(tokens):
        if w in shifters or w not in lexicon:
            continue
        score, subjectivity = lexicon[w]
        near = [(back, shifters[tokens[i - back]]) for back in (1, 2, 3) if i >= back and tokens[i - back] in shifters]
        score += math.copysign(1, score) * sum(x * (1.0, 0.95, 0.9)[back - 1] for back, (kind, x) in near if kind == "boost")
        if any(kind == "negate" for _, (kind, _x) in near):
            score *= -0.74
        s, k, sub = s + score, k + 1, sub + subjectivity
        signs.append(score)
    total = s + (math.copysign(1, s) if s else 0) * min(4, marks) * 0.292
    return k, s / k if k else 0.0, sub / k if k else 0.0, total / math.sqrt(total * total + 15), signs


def test_valence_against_a_fold_by_hand(spark):
    lexicon = {"good": (2.0, 0.6), "bad": (-2.5, 0.7), "fine": (1.0, 0.2), "not": (-1.0, 0.1)}
    shifters = {"not": ("negate", 0.0), "very": ("boost", 0.293), "slightly": ("boost", -0.293)}
    texts = ["good", "not good", "very very good!", "not a very good day!!!!!!", "slightly bad not", "bad very", "not one two three good",
             "not one two good", "very fine but not bad!", "nothing here", "", None, "good " * 40 + "not very bad"]
    lex = spark.createDataFrame([(w, *v) for w, v in lexicon.items()], "word string, score double, subjectivity double")
    shift = spark.createDataFrame([(w, *v) for w, v in shifters.items()], "word string, kind string, weight double")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = T.valence(df, "id", "text", lex, shift).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = r.text or ""
        tokens = t.replace("!", " ").split()
        k, polarity, sub, compound, signs = fold_by_hand(tokens, lexicon, shifters, t.count("!"))
        assert (r.n_matched, r.n_tokens) == (k, len(tokens)), t
        assert (r.polarity, r.subjectivity, r.compound) == pytest.approx((polarity, sub, compound)), t
        assert r.pos == pytest.approx(sum(x > 0 for x in signs) / len(tokens) if tokens else 0)


def test_lemma_table_takes_the_longest_fitting_suffix(spark):
    rules = spark.createDataFrame(list(T.SUFFIX_RULES), "suffix string, replacement string, least int")
    own = spark.createDataFrame([("mice", "mouse"), ("flies", "fly-x")], "word string, lemma string")
    want = {"cities": "city", "ties": "tie", "glass": "glass", "dogs": "dog", "bus": "bus", "classes": "class", "running": "run", "mice": "mouse",
            "flies": "fly-x", "sing": "sing", "agreed": "agree", "happily": "happy", "s": "s", "zebra": "zebra"}
    got = {r.word: r.lemma for r in T.lemma_table(spark.createDataFrame([(w,) for w in want], "word string"), rules, own).collect()}
    assert got == want
    assert T.lemma_table(spark.createDataFrame([("dogs",)], "word string"), rules.limit(0), own.limit(0)).first().lemma == "dogs"


def test_key_sample_does_not_depend_on_partitions(spark):
    df = spark.range(20_000)
    a = {r.id for r in io.sample(df.repartition(3), 0.05, 4, "id").collect()}
    b = {r.id for r in io.sample(df.repartition(17), 0.05, 4, "id").collect()}
    assert a == b and 850 < len(a) < 1150
    assert a != {r.id for r in io.sample(df, 0.05, 5, "id").collect()}
    assert io.sample(df.select(F.lit(None).cast("long").alias("id")), 1.0, 1, "id").count() == 20_000


def test_word_vectors_are_learned_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{(i * j) % 9}" for j in range(1, 21)]) for i in range(60)] + [(60, []), (61, None)], "id long, toks array<string>")
    filled = docs.withColumn("toks", F.coalesce("toks", F.array().cast("array<string>")))
    assert T.word2vec(filled, "toks", size=4, min_count=1)[0].getNumPartitions() == 1
    monkeypatch.setattr(T, "TOKENS_PER_PART", 400)
    model, out = T.word2vec(filled, "toks", size=4, min_count=1)
    assert model.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    assert out.count() == 62 and model.getVectors().count() == 9


def test_topics_read_their_input_once(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    seen = spark.sparkContext.accumulator(0)

    def vector(i):
        seen.add(1)
        return Vectors.sparse(6, {i % 6: 2.0, (i + 1) % 6: 1.0})

    df = spark.range(40).select("id", F.udf(vector, VectorUDT())("id").alias("tf"))
    _m, out = T.topics(df, "tf", k=3, max_iter=4)
    assert out.count() == 40 and out.select(F.sum(F.size(F.split(F.col("topics").cast("string"), ",")))).first()[0] == 120
    assert seen.value == 40
