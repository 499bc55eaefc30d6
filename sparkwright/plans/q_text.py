"""Catalogue: text features over whole documents and conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import text as T
from ..operators.relate import lookup_tokens
from .common import query, rounded, tbl

_TOKS = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\W+'), lambda x: length(x) >= 1)"
_TOKS_CASE = r"list_filter(regexp_split_to_array(coalesce({c}, ''), '\W+'), lambda x: length(x) >= 1)"


def _sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query("q_text_counts", f"""
SELECT doc_id,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_excl,
  CAST(len({_TOKS.format(c='text')}) AS BIGINT) AS n_tokens,
  CAST(len(list_filter({_TOKS_CASE.format(c='text')}, lambda x: regexp_matches(x, '[A-Z]'))) AS BIGINT) AS n_caps,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[.!?]\\s+')) + 1 AS BIGINT) AS n_sentences
FROM documents""")
def q_text_counts(spark, d):
    """N18, N19, N22 (per-row capital count, T3), X3 (sentences) on whole texts."""
    doc = tbl(spark, d, "documents")
    return doc.select("doc_id", TX.count_char("text", "!").alias("n_excl"),
                      TX.token_count("text").alias("n_tokens"),
                      TX.capital_token_count("text").alias("n_caps"),
                      TX.sentence_count("text").alias("n_sentences"))


@query("q_sentences", r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[.!?]\s+')) + 1 AS BIGINT) AS n_sentences
FROM documents""")
def q_sentences(spark, d):
    """X3 split form: size of the sentence array equals the boundary count + 1."""
    doc = tbl(spark, d, "documents")
    return doc.select("doc_id", TX.array_len(TX.sentences("text")).alias("n_sentences"))


@query("q_nonuseful", r"""
SELECT conv_id, turn,
  CASE WHEN lower(text) LIKE '%star%' OR lower(text) LIKE '%...%' OR regexp_extract(text, '[a-zA-Z]+', 0) = ''
            OR regexp_replace(text, '[\p{P}\p{Z}]', '', 'g') = '' THEN 1 ELSE 0 END AS non_useful,
  CASE WHEN text LIKE '%?%' THEN 1 ELSE 0 END AS has_question,
  CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS has_digit
FROM conversations""")
def q_nonuseful(spark, d):
    """X16 + F8 (LIKE / contains / RLIKE flags) on conversation turns."""
    from ..functions.columns import flag
    from ..operators.clean import match_flag
    c = tbl(spark, d, "conversations")
    return c.select("conv_id", "turn", TX.non_useful_flag("text").alias("non_useful"),
                    flag(match_flag("text", "?", "contains")).alias("has_question"),
                    flag(match_flag("text", "[0-9]", "rlike")).alias("has_digit"))


@query("q_clean_text", f"""
SELECT conv_id, turn,
  CAST(length(regexp_replace(lower(text), '[\\p{{P}}\\p{{Z}}]', '', 'g')) AS INTEGER) AS clean_len,
  CAST(len(list_filter(list_transform({_TOKS_CASE.format(c='text')}, lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')),
       lambda x: length(x) > 0)) AS BIGINT) AS n_norm_tokens,
  CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END AS has_the
FROM conversations""")
def q_clean_text(spark, d):
    """N17 (Unicode punctuation/space strip), X4 (letters-only tokens), X17 (contains)."""
    c = tbl(spark, d, "conversations")
    return c.select("conv_id", "turn", F.length(TX.clean_text("text")).alias("clean_len"),
                    TX.array_len(TX.normalise_tokens(TX.tokens("text", lower=False))).alias("n_norm_tokens"),
                    TX.contains_flag("text", "the").alias("has_the"))


@query("q_tokens", f"""
SELECT tok AS token, count(*) AS n FROM (SELECT unnest({_TOKS.format(c='text')}) AS tok FROM documents) GROUP BY tok""")
def q_tokens(spark, d):
    """N20 + X1/X2 + X7: token frequencies over the whole corpus."""
    doc = tbl(spark, d, "documents")
    ex = T.explode_tokens(doc, [], TX.tokens("text"))
    return ex.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_STOP_SQL = f"""
SELECT doc_id, CAST(len(list_filter({_TOKS.format(c='text')}, lambda x: NOT list_contains({_sql_list(T.STOPWORDS)}, lower(x))))
       AS BIGINT) AS n_clean
FROM documents"""


@query("q_stopwords", _STOP_SQL)
def q_stopwords(spark, d):
    """Tokens left after case-insensitive stop-word removal."""
    doc = tbl(spark, d, "documents")
    return doc.select("doc_id", TX.array_len(T.remove_stopwords(TX.tokens("text"))).alias("n_clean"))


def _lemma_case(x):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LEMMAS.items())
    return f"CASE {x} {whens} ELSE {x} END"


@query("q_lemma", f"""
SELECT {_lemma_case('tok')} AS token, count(*) AS n
FROM (SELECT unnest({_TOKS.format(c='text')}) AS tok FROM documents) GROUP BY 1""")
def q_lemma(spark, d):
    """Dictionary lemmatiser (literal map, in-row), then frequencies."""
    doc = tbl(spark, d, "documents").select(TX.tokens("text").alias("toks"))
    lem = lookup_tokens(doc, "toks", T.LEMMAS, out="lem", keep_unmatched=True)
    return T.explode_tokens(lem, [], "lem").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _lex_values():
    return ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in T.LEXICON.items())


_SENTIMENT_SQL = f"""
WITH t AS (SELECT doc_id, {_TOKS.format(c='text')} AS toks FROM documents),
u AS (SELECT doc_id, unnest(toks) AS tok FROM t),
lex(word, score) AS (VALUES {_lex_values()}),
m AS (SELECT u.doc_id, lex.score FROM u JOIN lex ON u.tok = lex.word),
a AS (SELECT doc_id, sum(score) AS s, count(*) AS k, count(*) FILTER (WHERE score > 0) AS npos,
             count(*) FILTER (WHERE score < 0) AS nneg FROM m GROUP BY doc_id),
j AS (SELECT t.doc_id, len(t.toks) AS n, coalesce(a.s, 0.0) AS s, coalesce(a.k, 0) AS k,
             coalesce(a.npos, 0) AS npos, coalesce(a.nneg, 0) AS nneg FROM t LEFT JOIN a ON t.doc_id = a.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(k AS BIGINT) AS n_matched,
  round(CASE WHEN k = 0 THEN 0.0 ELSE s / k END, 6) AS polarity,
  round(CASE WHEN n = 0 THEN 0.0 ELSE k / n END, 6) AS subjectivity,
  round(CASE WHEN n = 0 THEN 0.0 ELSE npos / n END, 6) AS pos,
  round(CASE WHEN n = 0 THEN 0.0 ELSE nneg / n END, 6) AS neg,
  round(1.0 - (CASE WHEN n = 0 THEN 0.0 ELSE npos / n END) - (CASE WHEN n = 0 THEN 0.0 ELSE nneg / n END), 6) AS neu,
  round(s / sqrt(s * s + 15.0), 6) AS compound
FROM j"""


@query("q_lexicon_sentiment", _SENTIMENT_SQL)
def q_lexicon_sentiment(spark, d):
    """X15 (+ J10 in-row lookup): lexicon sentiment per document, no UDF, no shuffle."""
    doc = tbl(spark, d, "documents").select("doc_id", "text")
    return rounded(T.sentiment(doc, "text").drop("text"))


@query("q_tf", f"""
WITH t AS (SELECT doc_id, {_TOKS.format(c='text')} AS toks FROM documents),
u AS (SELECT doc_id, len(toks) AS tot, unnest(toks) AS token FROM t)
SELECT doc_id, token, count(*) AS n, round(count(*) / max(tot), 6) AS tf FROM u GROUP BY doc_id, token""")
def q_tf(spark, d):
    """X8 long form + N21 true TF (count / document total, T9)."""
    doc = tbl(spark, d, "documents").select("doc_id", TX.tokens("text").alias("toks"))
    return rounded(T.term_counts(doc, "doc_id", "toks"))


@query("q_idf", f"""
WITH t AS (SELECT doc_id, {_TOKS.format(c='text')} AS toks FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(toks) AS token FROM t),
g AS (SELECT token, count(*) AS df FROM u GROUP BY token HAVING count(*) >= 2)
SELECT token, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS idf FROM g""")
def q_idf(spark, d):
    """X10 long form: document frequency and ln((N+1)/(df+1)), min df 2."""
    doc = tbl(spark, d, "documents").select("doc_id", TX.tokens("text").alias("toks"))
    return rounded(T.doc_freq(doc, "doc_id", "toks", min_df=2))


@query("q_embedding_mean", """
WITH u AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM u GROUP BY label, dim""")
def q_embedding_mean(spark, d):
    """Mean vector per label (long form: label, dim, mean)."""
    e = tbl(spark, d, "embeddings")
    return rounded(T.pool_vectors(e, "label", "embedding"))


@query("q_concat_vectors", """
SELECT vec_id, CAST(2 * len(embedding) + 1 AS INTEGER) AS n_dims,
       round(2 * list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) + abs(label), 6) AS l1
FROM embeddings""")
def q_concat_vectors(spark, d):
    """[embedding, embedding, label] as one ML vector; size and L1 norm."""
    from pyspark.ml.functions import vector_to_array
    e = tbl(spark, d, "embeddings")
    v = vector_to_array(T.concat_vectors("embedding", "embedding", F.array(F.col("label"))))
    return rounded(e.select("vec_id", F.size(v).alias("n_dims"),
                            F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x)).alias("l1")))


@query("q_stopwords_table", _STOP_SQL)
def q_stopwords_table(spark, d):
    """X5 through a word table joined by token (any number of words)."""
    words = spark.createDataFrame([(w,) for w in T.STOPWORDS], "word string")
    doc = tbl(spark, d, "documents").select("doc_id", TX.tokens("text").alias("toks"))
    return T.remove_words(doc, "doc_id", "toks", words).select("doc_id", TX.array_len("clean").alias("n_clean"))


@query("q_sentiment_table", _SENTIMENT_SQL)
def q_sentiment_table(spark, d):
    """X15 through a lexicon table joined by token (any number of words)."""
    lex = spark.createDataFrame([(k, float(v)) for k, v in T.LEXICON.items()], "word string, score double")
    doc = tbl(spark, d, "documents").select("doc_id", "text")
    return rounded(T.sentiment_table(doc, "doc_id", "text", lex).drop("text"))


# A lexicon of the corpus's own words, scored by rules of their letters: thousands of entries.
_LEX_SQL = f"""
WITH t AS (SELECT doc_id, text, {_TOKS.format(c='text')} AS toks FROM documents),
u AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM t),
v AS (SELECT word, (length(word) * 37 + ascii(word) * 11 + ascii(right(word, 1)) * 7) % 9 - 4 AS score,
  (length(word) * 13 + ascii(word) * 5) % 11 / 10.0 AS subjectivity
  FROM (SELECT DISTINCT word FROM u WHERE regexp_full_match(word, '[a-z]+'))),
x AS (SELECT word, CASE WHEN score <> 0 THEN 'term' WHEN length(word) % 2 = 0 THEN 'negate' ELSE 'boost' END AS kind, score, subjectivity,
  CASE WHEN ascii(word) % 2 = 0 THEN 0.293 ELSE -0.293 END AS weight FROM v)"""


def _corpus_lexicon(doc):
    """(word, score, subjectivity) of the terms and (word, kind, weight) of the shifters."""
    w = T.explode_tokens(doc.select(TX.tokens("text").alias("toks")), [], "toks", "word").where(F.col("word").rlike("^[a-z]+$")).distinct()
    n, a, z = F.length("word"), F.ascii("word"), F.ascii(F.right("word", F.lit(1)))
    w = w.select("word", (F.pmod(n * 37 + a * 11 + z * 7, F.lit(9)) - 4).cast("double").alias("score"),
                 (F.pmod(n * 13 + a * 5, F.lit(11)) / 10.0).alias("subjectivity"))
    kind = F.when(F.length("word") % 2 == 0, "negate").otherwise("boost")
    return w.where("score <> 0"), w.where("score = 0").select("word", kind.alias("kind"), F.when(F.ascii("word") % 2 == 0, 0.293).otherwise(-0.293).alias("weight"))


def _lags():
    return ", ".join(f"lag({c}, {i}) OVER w AS {c}{i}" for i in (1, 2, 3) for c in ("pos", "kind", "weight"))


_BOOST = " + ".join(f"CASE WHEN kind{i} = 'boost' AND pos - pos{i} <= 3 THEN weight{i} * [1.0, 0.95, 0.9][pos - pos{i}] ELSE 0 END" for i in (1, 2, 3))
_NEGATED = " OR ".join(f"coalesce(kind{i} = 'negate' AND pos - pos{i} <= 3, false)" for i in (1, 2, 3))


@query("q_valence", _LEX_SQL + f""",
h AS (SELECT doc_id, pos, kind, CAST(score AS DOUBLE) AS score, CAST(subjectivity AS DOUBLE) AS subjectivity, CAST(weight AS DOUBLE) AS weight
  FROM u JOIN x USING (word)),
l AS (SELECT *, {_lags()} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT doc_id, subjectivity, (score + sign(score) * ({_BOOST})) * CASE WHEN {_NEGATED} THEN -0.74 ELSE 1.0 END AS s FROM l WHERE kind = 'term'),
g AS (SELECT doc_id, count(*) AS k, sum(s) AS s, avg(s) AS polarity, avg(subjectivity) AS subjectivity,
  count(*) FILTER (s > 0) AS np, count(*) FILTER (s < 0) AS nn FROM m GROUP BY doc_id),
j AS (SELECT t.doc_id, len(toks) AS n, coalesce(k, 0) AS k, coalesce(polarity, 0) AS polarity, coalesce(subjectivity, 0) AS subjectivity,
  coalesce(np, 0) AS np, coalesce(nn, 0) AS nn,
  coalesce(s, 0) + sign(coalesce(s, 0)) * 0.292 * least(4, length(text) - length(replace(text, '!', ''))) AS s FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(k AS BIGINT) AS n_matched, round(polarity, 6) AS polarity, round(subjectivity, 6) AS subjectivity,
  round(CASE WHEN n = 0 THEN 0.0 ELSE np / n END, 6) AS pos, round(CASE WHEN n = 0 THEN 0.0 ELSE nn / n END, 6) AS neg,
  round(1.0 - CASE WHEN n = 0 THEN 0.0 ELSE np / n END - CASE WHEN n = 0 THEN 0.0 ELSE nn / n END, 6) AS neu,
  round(s / sqrt(s * s + 15.0), 6) AS compound FROM j""")
def q_valence(spark, d):
    """Valence shifting (negation, intensifiers, exclamation) over a lexicon table of the corpus's own words."""
    doc = tbl(spark, d, "documents").select("doc_id", "text")
    terms, shifters = _corpus_lexicon(doc)
    return rounded(T.valence(doc, "doc_id", "text", terms, shifters).drop("text"))


_RULE_ROWS = ", ".join(f"('{a}', '{b}', {n})" for a, b, n in T.SUFFIX_RULES)
_LEMMA_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in T.LEMMAS.items())


@query("q_lemma_rules", f"""
WITH u AS (SELECT unnest({_TOKS.format(c='text')}) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM u GROUP BY word),
r(suffix, replacement, least) AS (VALUES {_RULE_ROWS}), e(word, lemma) AS (VALUES {_LEMMA_ROWS}),
b AS (SELECT c.word, arg_max(left(c.word, length(c.word) - length(suffix)) || replacement, length(suffix)) AS ruled
  FROM c JOIN r ON ends_with(c.word, suffix) AND length(c.word) - length(suffix) >= least GROUP BY c.word)
SELECT coalesce(e.lemma, b.ruled, c.word) AS lemma, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_forms
FROM c LEFT JOIN b ON b.word = c.word LEFT JOIN e ON e.word = c.word GROUP BY 1""")
def q_lemma_rules(spark, d):
    """Longest-suffix rules and exceptions from tables, over the distinct words; frequencies of the lemmas."""
    words = T.explode_tokens(tbl(spark, d, "documents").select(TX.tokens("text").alias("toks")), [], "toks", "word")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame(list(T.SUFFIX_RULES), "suffix string, replacement string, least int")
    own = spark.createDataFrame(list(T.LEMMAS.items()), "word string, lemma string")
    table = T.lemma_table(counts.select("word"), rules, own)
    return counts.join(table, "word").groupBy("lemma").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_forms"))


# ------------------------------------------------------- ML text stages

def _doc_tokens(spark, d):
    return tbl(spark, d, "documents").select("doc_id", T.remove_stopwords(TX.tokens("text")).alias("toks"))


@query("q_hash", f"""
WITH t AS (SELECT doc_id, list_filter({_TOKS.format(c='text')}, lambda x: NOT list_contains({_sql_list(T.STOPWORDS)}, lower(x))) AS toks
           FROM documents)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens FROM t""")
def q_hash(spark, d):
    """X9 + X10: hashed term frequencies (10,000 wide) and fitted IDF, sparse throughout; the hashed counts
    of a document sum to its tokens (the IDF stage must keep every counted slot)."""
    tf = T.hash_tf(_doc_tokens(spark, d), "toks", "tf", 10_000)
    _m, out = T.idf(tf, "tf", "tfidf")
    one = T.sparse_sum("tf")
    return out.select("doc_id", F.when(T.sparse_size("tfidf") <= T.sparse_size("tf"), one).cast("long").alias("n_tokens"))


@query("q_countvec", f"""
WITH t AS (SELECT doc_id, list_filter({_TOKS.format(c='text')}, lambda x: NOT list_contains({_sql_list(T.STOPWORDS)}, lower(x))) AS toks
           FROM documents),
u AS (SELECT doc_id, unnest(toks) AS tok FROM t),
v AS (SELECT tok FROM u GROUP BY tok HAVING count(DISTINCT doc_id) >= 2 ),
c AS (SELECT u.doc_id, u.tok, count(*) AS n FROM u JOIN v ON u.tok = v.tok GROUP BY u.doc_id, u.tok),
s AS (SELECT doc_id, max(n) AS mx, sum(n) AS tot FROM c GROUP BY doc_id)
SELECT t.doc_id, round(coalesce(s.mx / s.tot, 0.0), 6) AS tf_max FROM t LEFT JOIN s ON t.doc_id = s.doc_id""")
def q_countvec(spark, d):
    """X8 + N21: CountVectorizer (min DF 2, no cap on the vocabulary) and true TF by L1
    normalisation, sparse throughout; the largest term share per document."""
    _m, out = T.count_vectors(_doc_tokens(spark, d), "toks", "tf", min_df=2.0)
    out = T.tf_normalise(out, "tf", "tf_norm")
    return rounded(out.select("doc_id", T.sparse_max("tf_norm").alias("tf_max")))


@query("q_lda", "SELECT doc_id, CAST(1.0 AS DOUBLE) AS mixture_sum FROM documents")
def q_lda(spark, d):
    """X11: LDA topic mixture per document (k=100, 10 iterations, whole vocabulary); a mixture sums to 1."""
    from pyspark.ml.functions import vector_to_array
    _m, _lm, out = _fitted_topics(spark, d)
    mix = F.aggregate(vector_to_array("topics"), F.lit(0.0), lambda a, x: a + x)
    # a document without any counted token has no mixture (all zero)
    return rounded(out.select("doc_id", F.when(mix == 0, 1.0).otherwise(mix).alias("mixture_sum")))


def _fitted_topics(spark, d):
    cm, cv = T.count_vectors(_doc_tokens(spark, d), "toks", "tf", wide=True)
    lm, out = T.topics(cv.drop("toks"), "tf", k=100, max_iter=10)
    return cm, lm, out


@query("q_lda_top")
def q_lda_top(spark, d):
    """X11: the three strongest of 100 topics of every document, with their weights."""
    _v, _m, out = _fitted_topics(spark, d)
    return T.top_topics(out, "doc_id", "topics", 3)


@query("q_lda_terms")
def q_lda_terms(spark, d):
    """X11: the ten strongest terms of each of 100 topics."""
    vocabulary, model, _out = _fitted_topics(spark, d)
    return T.topic_terms(model, vocabulary, spark, 10)


@query("q_hash_slots")
def q_hash_slots(spark, d):
    """X9 + X10: slots of a document's hashed terms, those that the IDF (minDocFreq 2) keeps, and its TF-IDF sum and largest value."""
    tf = T.hash_tf(_doc_tokens(spark, d), "toks", "tf", 10_000)
    _m, out = T.idf(tf, "tf", "tfidf", min_doc_freq=2)
    return out.select("doc_id", T.sparse_size("tf").cast("long").alias("n_slots"), T.sparse_size("tfidf").cast("long").alias("n_kept"),
                      T.sparse_sum("tfidf").alias("tfidf_sum"), T.sparse_max("tfidf").alias("tfidf_max"))


@query("q_word2vec")
def q_word2vec(spark, d):
    """X12 + X13: Word2Vec (size 100, min count 5) and the per-document mean vector."""
    from pyspark.ml.functions import vector_to_array
    _m, out = T.word2vec(_doc_tokens(spark, d), "toks", size=100, min_count=5)
    return out.select("doc_id", vector_to_array("w2v").alias("mean_vector"))
