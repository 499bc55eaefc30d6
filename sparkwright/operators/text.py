"""Text features (X5-X15, J10 uses).

Per-document features are computed inside the row with higher-order
functions over the token array (no explode, no shuffle, whole texts).
Corpus statistics (document frequency, vocabularies, topic and embedding
models) are distributed aggregates or Spark ML estimators.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens as _tokens
from ..session import cut_lineage, ship_library
from . import lda

# A small English stop-word list used by X5 (this repo's own
# list; pass ``words=`` to use another, e.g. StopWordsRemover's default).
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have",
    "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "of", "on", "or", "our", "she",
    "so", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we",
    "were", "what", "when", "which", "who", "will", "with", "would", "you", "your",
)

# A small sentiment lexicon for X15 (this repo's own words and
# scores, whole numbers from -3 to 3). Pass a table for a larger one.
LEXICON = {
    "good": 2, "great": 3, "excellent": 3, "love": 3, "like": 1, "nice": 2, "best": 3, "better": 2, "happy": 3,
    "well": 1, "fine": 1, "useful": 2, "easy": 2, "perfect": 3, "recommend": 2, "fast": 1, "clean": 1, "fun": 2,
    "works": 1, "helpful": 2,
    "bad": -2, "poor": -2, "terrible": -3, "hate": -3, "worst": -3, "awful": -3, "broken": -2, "slow": -1,
    "waste": -2, "problem": -1, "wrong": -2, "difficult": -1, "disappointed": -2, "useless": -2, "cheap": -1,
    "never": -1, "not": -1, "no": -1,
}

# Lemma table for X6 (inflected form -> lemma).
LEMMAS = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "am": "be",
    "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do",
    "made": "make", "makes": "make", "said": "say", "says": "say", "went": "go", "goes": "go",
    "better": "good", "best": "good", "children": "child", "men": "man", "women": "woman",
}

COMPOUND_ALPHA = 15.0   # fixed value of the published compound score: s / sqrt(s^2 + 15)
TOKENS_PER_PART = 1_000_000   # tokens that one task of a Word2Vec fit learns from, at least
MAX_LITERAL = 256       # entries of a word list that may be a literal in the plan; more belong in a table


def _bounded(words) -> list:
    words = list(words)
    if len(words) > MAX_LITERAL:
        raise ValueError(f"{len(words)} words: use the table form for more than {MAX_LITERAL}")
    return words


def _lit_map(m: Mapping[str, object]) -> Column:
    return F.create_map(*[x for k in _bounded(m) for x in (F.lit(k), F.lit(m[k]))])


def remove_stopwords(tok: str | Column, words: Sequence[str] = STOPWORDS, case_sensitive: bool = False) -> Column:
    """Drop stop words (at most ``MAX_LITERAL``) from a token array, case-insensitive by default."""
    t = F.col(tok) if isinstance(tok, str) else tok
    ws = [w if case_sensitive else w.lower() for w in _bounded(words)]
    # isin is a look-up in a set, array_contains goes through the words; both drop null tokens
    return F.filter(t, lambda x: ~(x if case_sensitive else F.lower(x)).isin(ws) if ws else x.isNotNull())


def remove_words(df: DataFrame, key: str, tok: str, words: DataFrame, out: str = "clean") -> DataFrame:
    """X5 with a word table of any size (column ``word``, lower case): tokens joined by word.

    ``key`` identifies a row. Rows whose tokens are all removed get an empty array.
    """
    ex = df.select(key, F.posexplode(tok).alias("_pos", "_tok"))
    left = ex.join(words.select(F.lower("word").alias("_word")).distinct(), F.lower("_tok") == F.col("_word"), "left_anti")
    kept = left.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_tok"))), lambda s: s["_tok"]).alias(out))
    return df.join(kept, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def lemmatise(tok: str | Column, lemmas: Mapping[str, str] = LEMMAS) -> Column:
    """Dictionary lemmatiser; unknown tokens pass through."""
    t = F.col(tok) if isinstance(tok, str) else tok
    m = _lit_map(lemmas)
    return F.transform(t, lambda x: F.coalesce(F.try_element_at(m, x), x))


def sentiment(df: DataFrame, text: str, lexicon: Mapping[str, float] = LEXICON, prefix: str = "") -> DataFrame:
    """Lexicon sentiment per document, computed in the row.

    Adds n_tokens, n_matched, polarity (mean matched score), subjectivity
    (matched share), pos/neg/neu (token shares) and compound
    (``s / sqrt(s^2 + 15)`` of the score sum ``s``).
    """
    m = _lit_map({k: float(v) for k, v in lexicon.items()})
    # each intermediate array is its own projection, computed once per row:
    # referencing one expression from many output columns would re-run the
    # tokeniser and the lookups for every reference
    t = df.withColumn("_toks", _tokens(text))
    t = t.withColumn("_sc", F.filter(F.transform("_toks", lambda w: F.try_element_at(m, w)),
                                     lambda x: x.isNotNull()))
    t = t.withColumns({
        "_n": F.size("_toks"), "_k": F.size("_sc"),
        "_s": F.aggregate("_sc", F.lit(0.0), lambda acc, x: acc + x),
        "_np": F.size(F.filter("_sc", lambda x: x > 0)), "_nn": F.size(F.filter("_sc", lambda x: x < 0)),
    }).drop("_toks", "_sc")
    return _scores(t, prefix)


def _scores(t: DataFrame, prefix: str) -> DataFrame:
    """Sentiment columns from _n tokens, _k matched, _s score sum, _np and _nn positive and negative matches."""
    n, k, s = F.col("_n").cast("double"), F.col("_k").cast("double"), F.col("_s")
    share = lambda a: F.coalesce(F.try_divide(a.cast("double"), n), F.lit(0.0))
    cols = {
        "n_tokens": F.col("_n").cast("long"), "n_matched": F.col("_k").cast("long"),
        "polarity": F.coalesce(F.try_divide(s, k), F.lit(0.0)),
        "subjectivity": share(F.col("_k")), "pos": share(F.col("_np")), "neg": share(F.col("_nn")),
        "compound": s / F.sqrt(s * s + F.lit(COMPOUND_ALPHA)),
    }
    cols["neu"] = F.lit(1.0) - cols["pos"] - cols["neg"]
    return t.withColumns({prefix + k_: v for k_, v in cols.items()}).drop("_n", "_k", "_s", "_np", "_nn")


def sentiment_table(df: DataFrame, key: str, text: str, lexicon: DataFrame, prefix: str = "") -> DataFrame:
    """X15/D2 with a lexicon table of any size (word, score): tokens are counted per row, joined by word
    and summed per row (``key`` identifies it)."""
    t = df.withColumn("_toks", _tokens(text))
    ex = explode_tokens(t.select(key, "_toks"), key, "_toks", "word").groupBy(key, "word").agg(F.count(F.lit(1)).alias("_c"))
    hit = ex.join(lexicon.select("word", F.col("score").cast("double").alias("score")), "word")
    g = hit.groupBy(key).agg(
        F.sum("_c").alias("_k"), F.sum(F.col("_c") * F.col("score")).alias("_s"),
        F.sum(F.when(F.col("score") > 0, F.col("_c"))).alias("_np"), F.sum(F.when(F.col("score") < 0, F.col("_c"))).alias("_nn"))
    t = t.withColumn("_n", F.size("_toks")).drop("_toks").join(g, key, "left")
    return _scores(t.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("_k", "_np", "_nn")})
                   .withColumn("_s", F.coalesce("_s", F.lit(0.0))), prefix)


# Fixed values of the published rule set for short texts: what an intensifier
# adds, how it fades with distance, what a negation turns a score into, what an exclamation mark adds.
REACH = 3
FADE = (1.0, 0.95, 0.9)
NEGATED = -0.74
EXCLAIMED, EXCLAIM_MOST = 0.292, 4


def valence(df: DataFrame, key: str, text: str, lexicon: DataFrame, shifters: DataFrame, prefix: str = "") -> DataFrame:
    """Rule-based sentiment with valence shifting, lexicon tables of any size.

    ``lexicon``: word, score, subjectivity; ``shifters``: word, kind (``negate`` or
    ``boost``), weight; a word in both is a shifter. A term's score moves away
    from zero by the weight of each boost among the three tokens before it,
    fading with distance, and is turned by ``NEGATED`` if one of them
    negates. Up to four exclamation marks strengthen the text's sum.

    Adds n_tokens, n_matched (terms), polarity (mean shifted score),
    subjectivity (mean of the terms'), pos/neg/neu (shares of tokens) and
    compound (``s / sqrt(s^2 + 15)`` of the sum). ``key`` identifies a row. Only
    tokens of the two tables travel: they are joined by word and folded per text.
    """
    t = df.withColumn("_toks", _tokens(text))
    marks = shifters.select("word", "kind", F.lit(0.0).alias("score"), F.lit(0.0).alias("subjectivity"), F.col("weight").cast("double").alias("weight"))
    terms = lexicon.join(shifters, "word", "left_anti").select(
        "word", F.lit("term").alias("kind"), F.col("score").cast("double").alias("score"),
        F.col("subjectivity").cast("double").alias("subjectivity"), F.lit(0.0).alias("weight"))
    ex = t.select(key, F.posexplode_outer("_toks").alias("_pos", "word")).where(F.col("word").isNotNull())
    hit = ex.join(terms.unionByName(marks), "word").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "kind", "score", "subjectivity", "weight"))).alias("_hits"))

    def shifted(x: Column, i: Column) -> Column:
        boost, negated = F.lit(0.0), F.lit(False)
        for back in range(1, REACH + 1):        # the tables' tokens among the three before it are the entries before it
            y = F.get("_hits", i - back)
            far = x["_pos"] - y["_pos"]
            fade = F.get(F.array(*[F.lit(f) for f in FADE]), (far - 1).cast("int"))
            boost = boost + F.when((y["kind"] == "boost") & (far <= REACH), y["weight"] * fade).otherwise(0.0)
            negated = negated | F.coalesce((y["kind"] == "negate") & (far <= REACH), F.lit(False))
        moved = x["score"] + F.signum(x["score"]) * boost
        return F.struct(F.when(negated, moved * NEGATED).otherwise(moved).alias("s"), x["subjectivity"].alias("subjectivity"),
                        (x["kind"] == "term").alias("term"))

    scored = hit.select(key, F.filter(F.transform("_hits", shifted), lambda x: x["term"]).alias("_terms"))
    g = scored.select(key, F.size("_terms").alias("_k"), F.aggregate("_terms", F.lit(0.0), lambda a, x: a + x["s"]).alias("_s"),
                      F.aggregate("_terms", F.lit(0.0), lambda a, x: a + x["subjectivity"]).alias("_sub"),
                      F.size(F.filter("_terms", lambda x: x["s"] > 0)).alias("_np"), F.size(F.filter("_terms", lambda x: x["s"] < 0)).alias("_nn"))
    loud = F.least(F.length(text) - F.length(F.replace(F.col(text), F.lit("!"), F.lit(""))), F.lit(EXCLAIM_MOST)) * EXCLAIMED
    t = t.withColumns({"_n": F.size("_toks"), "_loud": F.coalesce(loud, F.lit(0.0))}).drop("_toks").join(g, key, "left")
    t = t.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("_k", "_s", "_sub", "_np", "_nn")})
    n, k, s = F.col("_n").cast("double"), F.col("_k").cast("double"), F.col("_s").cast("double")
    total = s + F.signum(s) * F.col("_loud")
    share = lambda a: F.coalesce(F.try_divide(a.cast("double"), n), F.lit(0.0))
    pos, neg = share(F.col("_np")), share(F.col("_nn"))
    cols = {"n_tokens": F.col("_n").cast("long"), "n_matched": F.col("_k").cast("long"),
            "polarity": F.coalesce(F.try_divide(s, k), F.lit(0.0)), "subjectivity": F.coalesce(F.try_divide(F.col("_sub").cast("double"), k), F.lit(0.0)),
            "pos": pos, "neg": neg, "neu": F.lit(1.0) - pos - neg, "compound": total / F.sqrt(total * total + F.lit(COMPOUND_ALPHA))}
    return t.withColumns({prefix + c: v for c, v in cols.items()}).drop("_n", "_k", "_s", "_sub", "_np", "_nn", "_loud")


# English inflections for X6 (suffix, replacement, letters that must remain before it).
SUFFIX_RULES = (
    ("ies", "y", 2), ("sses", "ss", 1), ("shes", "sh", 1), ("ches", "ch", 1), ("xes", "x", 1), ("s", "", 3), ("ss", "ss", 1), ("us", "us", 1),
    ("ied", "y", 2), ("eed", "ee", 1), ("ed", "", 3), ("nning", "n", 1), ("tting", "t", 1), ("ing", "", 3), ("iest", "y", 2), ("est", "", 3),
    ("ily", "y", 2), ("ly", "", 3), ("ier", "y", 2),
)


def lemma_table(words: DataFrame, rules: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Word -> lemma for a table of distinct words (column ``word``), any language.

    ``exceptions`` (word, lemma) come first. Else the longest suffix of
    ``rules`` (suffix, replacement, least letters before it) that fits is
    replaced: a word meets the rules by its endings, one probe per length.
    Other words stay as they are. Runs over distinct words, not over tokens.
    """
    longest = rules.agg(F.max(F.length("suffix"))).first()[0] or 0
    n = F.length("word")
    ends = words.select("word", F.explode(F.sequence(F.lit(1), F.lit(max(1, longest)))).alias("_k"))
    ends = ends.where(F.col("_k") < n).withColumn("suffix", F.right("word", F.col("_k")))
    hit = ends.join(rules.select("suffix", "replacement", "least"), "suffix").where(n - F.col("_k") >= F.col("least"))
    best = hit.groupBy("word").agg(F.max_by(F.concat(F.left("word", n - F.col("_k")), F.col("replacement")), F.col("_k")).alias("_ruled"))
    own = exceptions.select("word", F.col("lemma").alias("_own"))
    return words.join(best, "word", "left").join(own, "word", "left").select("word", F.coalesce("_own", "_ruled", "word").alias("lemma"))


def explode_tokens(df: DataFrame, keep, arr: str | Column, out: str = "token", extra=()) -> DataFrame:
    """One row per token (empty and null arrays give no row).

    ``explode_outer`` + a null filter on the generated column: a plain
    ``explode`` makes Catalyst add a ``size(arr) > 0`` filter that evaluates
    the (expensive) token expression a second time.
    """
    keep = [keep] if isinstance(keep, str) else list(keep)
    a = F.col(arr) if isinstance(arr, str) else arr
    return df.select(*keep, *extra, F.explode_outer(a).alias(out)).filter(F.col(out).isNotNull())


def term_counts(df: DataFrame, id_col: str, tok: str) -> DataFrame:
    """X8 long form: (id, token, n, tf) with tf = n / tokens in the document.

    Groups are (document, token) pairs: bounded by one document's length.
    """
    # the token array is read once: its size travels with the exploded
    # tokens, so no second pass over the documents and no join back
    base = df.select(id_col, F.col(tok).alias("_t"))
    ex = explode_tokens(base, id_col, "_t", extra=[F.size("_t").alias("_tot")])
    c = ex.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"), F.max("_tot").alias("_tot"))
    return c.withColumn("tf", F.col("n") / F.col("_tot")).drop("_tot")


def doc_freq(df: DataFrame, id_col: str, tok: str, min_df: int = 1) -> DataFrame:
    """X10 long form: (token, df, idf) with Spark's ``ln((N+1)/(df+1))``.

    Distinct tokens are taken per row first (``array_distinct``), so the
    per-token count is a plain partial aggregate; N is a scalar subquery.
    """
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    ex = explode_tokens(df, [], F.array_distinct(F.col(tok)))
    g = ex.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    return g.withColumn("idf", F.log((n_docs + F.lit(1)) / (F.col("df") + F.lit(1))))


def pool_vectors(df: DataFrame, by: str | Sequence[str], vec: str) -> DataFrame:
    """Mean of array vectors per group, long form (by..., dim, mean).

    Groups are (group, dimension): a hot group is combined map-side.
    """
    by = [by] if isinstance(by, str) else list(by)
    ex = df.select(*by, F.posexplode(F.col(vec)).alias("dim", "_x"))
    return ex.groupBy(*by, "dim").agg(F.avg(F.col("_x").cast("double")).alias("mean"))


def pool_vectors_array(df: DataFrame, by: str | Sequence[str], vec: str, out: str = "mean_vec") -> DataFrame:
    """X13 as one array per group, assembled from the long form (dims are few)."""
    by = [by] if isinstance(by, str) else list(by)
    long = pool_vectors(df, by, vec)
    return long.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias(out))


def concat_vectors(*cols: str | Column) -> Column:
    """Concatenate array columns and turn them into one ML vector."""
    from pyspark.ml.functions import array_to_vector
    arrs = [(F.col(c) if isinstance(c, str) else c).cast("array<double>") for c in cols]
    return array_to_vector(F.concat(*arrs))


# ----------------------------------------------------- Spark ML estimators

def count_vectors(df: DataFrame, col: str, out: str = "tf", vocab_size: int = 2**31 - 1, min_df: float = 1.0,
                  max_df: float | None = None, min_tf: float = 1.0, wide: bool = False):
    """Fit ``CountVectorizer``; returns (model, transformed).

    No term is cut off unless ``vocab_size`` is given; the fitted vocabulary
    is held by the driver, so for one that has no bound use ``wide``,
    ``term_counts`` or ``hash_tf``. ``min_df``/``max_df`` below 1 are document shares, otherwise
    counts (``max_df=None`` keeps Spark's unbounded default).

    ``wide`` counts every term and gathers no vocabulary: ``out`` holds 64-bit hashes
    of the terms (``indices``) and their counts (``values``), for ``topics``.
    """
    if wide:
        if (vocab_size, min_df, max_df, min_tf) != (2**31 - 1, 1.0, None, 1.0):
            raise ValueError("the wide form counts every term")
        ship_library(df.sparkSession)
        count = F.arrow_udf(lda.counted, lda.COUNTS)
        return lda.Terms(df, col), df.withColumn(out, count(F.transform(col, lambda w: F.xxhash64(w))))
    from pyspark.ml.feature import CountVectorizer
    cv = CountVectorizer(inputCol=col, outputCol=out, vocabSize=vocab_size, minDF=min_df, minTF=min_tf)
    if max_df is not None:
        cv = cv.setMaxDF(max_df)
    m = cv.fit(df)
    return m, m.transform(df)


def tf_normalise(df: DataFrame, col: str, out: str = "tf_norm", mode: str = "total") -> DataFrame:
    """N21/T9 on an ML count vector, sparse throughout.

    ``total``: counts divided by the row's count total (L1 ``Normalizer``,
    true TF). ``length``: counts divided by the vector size (reference).
    """
    if mode == "total":
        from pyspark.ml.feature import Normalizer
        return Normalizer(inputCol=col, outputCol=out, p=1.0).transform(df)
    # vectors of one column share their size: read it from the ML metadata (a constant)
    size = df.schema[col].metadata.get("ml_attr", {}).get("num_attrs")
    if size is None:
        size = df.select(col).first()[col].size
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors
    return ElementwiseProduct(inputCol=col, outputCol=out, scalingVec=Vectors.dense([1.0 / size] * size)).transform(df)


def _values(col: str) -> Column:
    """Stored values of an ML vector, without filling in its zeros."""
    return F.from_json(F.get_json_object(F.to_json(F.struct(F.col(col).alias("v"))), "$.v.values"), "array<double>")


def sparse_size(col: str) -> Column:
    """Number of stored values of an ML vector."""
    return F.size(_values(col))


def sparse_sum(col: str) -> Column:
    return F.aggregate(_values(col), F.lit(0.0), lambda a, x: a + x)


def sparse_max(col: str) -> Column:
    """Largest stored value of an ML vector (0 without any)."""
    return F.coalesce(F.array_max(_values(col)), F.lit(0.0))


def hash_tf(df: DataFrame, col: str, out: str = "tf", n_features: int = 10_000) -> DataFrame:
    """``HashingTF`` (no fit, no vocabulary state)."""
    from pyspark.ml.feature import HashingTF
    return HashingTF(inputCol=col, outputCol=out, numFeatures=n_features).transform(df)


def idf(df: DataFrame, col: str, out: str = "tfidf", min_doc_freq: int = 0):
    """Fit ``IDF``; returns (model, transformed)."""
    from pyspark.ml.feature import IDF
    m = IDF(inputCol=col, outputCol=out, minDocFreq=min_doc_freq).fit(df)
    return m, m.transform(df)


def topics(df: DataFrame, col: str, k: int = 100, max_iter: int = 10, seed: int = 7, out: str = "topics"):
    """X11: LDA topic mixture per document; returns (model, transformed).

    Every iteration reads all of ``df`` and each of its tasks returns a sum per
    term and topic, so the vectors are kept by a checkpoint, in no more
    parts than there are cores. Vectors of the wide form (``count_vectors``) are
    fitted by the same steps without a task that holds all terms (``lda.py``).
    """
    if "indices" in getattr(df.schema[col].dataType, "names", ()):
        return lda.fit(df, col, k, max_iter, seed, out)
    from pyspark.ml.clustering import LDA
    cores = df.sparkSession.sparkContext.defaultParallelism
    df = cut_lineage(df.coalesce(cores))
    m = LDA(featuresCol=col, k=k, maxIter=max_iter, seed=seed, topicDistributionCol=out).fit(df)
    return m, m.transform(df)


def topic_terms(model, vocabulary: Sequence[str] | lda.Terms, spark, n: int | None = 10) -> DataFrame:
    """X11: (topic, rank, term, weight), the ``n`` strongest terms of each topic (``None``: all), weights of a topic's terms sum to 1.

    A model of the wide form takes the count vectors' model as ``vocabulary``; ties go by hash.
    """
    if isinstance(vocabulary, lda.Terms):
        top = model.strongest(n)
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "at")))
        words = vocabulary.table.join(top.select("at").distinct(), "at", "left_semi").groupBy("at").agg(F.min("term").alias("term"))
        return ranked.join(words, "at").select("topic", "rank", "term", "weight")
    words = spark.createDataFrame(list(enumerate(vocabulary)), "at int, term string")
    top = model.describeTopics(n or len(vocabulary))
    pairs = top.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    return pairs.select("topic", (F.col("rank") + 1).alias("rank"), F.col("t.termIndices").alias("at"), F.col("t.termWeights").alias("weight")) \
        .join(words, "at").select("topic", "rank", "term", "weight")


def top_topics(df: DataFrame, key: str, col: str = "topics", n: int = 3) -> DataFrame:
    """X11: (key, rank, topic, weight), the ``n`` strongest topics of a document, ties to the smaller number;
    a document without counted tokens has no topic."""
    from pyspark.ml.functions import vector_to_array
    pairs = F.transform(vector_to_array(col), lambda w, i: F.struct((-w).alias("w"), i.alias("topic")))
    best = F.slice(F.array_sort(F.filter(pairs, lambda x: x["w"] < 0)), 1, n)
    return df.select(key, F.posexplode(best).alias("rank", "t")).select(
        key, (F.col("rank") + 1).alias("rank"), F.col("t.topic").alias("topic"), (-F.col("t.w")).alias("weight"))


def word2vec(df: DataFrame, col: str, size: int = 100, min_count: int = 5, seed: int = 7,
             out: str = "w2v", max_iter: int = 1):
    """Word2Vec; the transform averages the token vectors of each document.

    Spark trains each part of the rows in one task and averages the parts'
    vectors: one part per ``TOKENS_PER_PART`` tokens, at most one per core.
    """
    from pyspark.ml.feature import Word2Vec
    tokens = df.agg(F.sum(F.greatest(F.size(col), F.lit(0)))).first()[0] or 0
    parts = max(1, min(tokens // TOKENS_PER_PART, df.sparkSession.sparkContext.defaultParallelism))
    m = Word2Vec(inputCol=col, outputCol=out, vectorSize=size, minCount=min_count, seed=seed,
                 maxIter=max_iter, numPartitions=parts).fit(df)
    return m, m.transform(df)
