from __future__ import annotations

import zlib

from llm_support import clash, docs, no_docs, sf  # noqa: F401

from sparkwright.llm import catalog, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_in_the_trie_equals_edit_distance():
    terms = ["idiot", "trash", "worthless", "scummy", "clown"]
    trie = toxicity.Trie(terms)
    words = ["idiot", "idot", "idiott", "ydiot", "trsh", "tarsh", "crown", "town", "clowns", "xclown", "worthles", "worhtless",
             "scumy", "scmumy", "", "a", "trashed", "idi", "diot"]
    for k in (0, 1, 2):
        for w in words:
            near = {t for t in terms if distance(t, w) <= k}
            got = trie.near(w, k)
            assert (got in near) if near else got is None, (w, k)


def test_shortcut_loses_no_term_at_distance_one():
    lex = toxicity.Lexicon(frozenset(["idiot", "worthless"]), frozenset())
    for t in lex.words:
        near = {t[:i] + t[i + 1:] for i in range(len(t))} | {t[:i] + "z" + t[i:] for i in range(len(t) + 1)} \
            | {t[:i] + "z" + t[i + 1:] for i in range(len(t))}
        assert all(lex.kind(w) == 3 for w in near)


def osa(a, b):
    """Edit distance with swapped neighbours as one edit, by the full table."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not (i and j)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_lookup_equals_edit_distance_with_swaps():
    import random
    rng = random.Random(7)
    terms, stems = ["abca", "bacab", "cabbaacb", "abcabcabc"], ["bccb", "caacbabb"]
    lex = toxicity.Lexicon(frozenset(terms), frozenset(stems))
    edits = lambda t: 2 if len(t) >= 8 else 1
    for _ in range(4000):
        w = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        near = any(osa(t, w) <= edits(t) for t in terms) \
            or any(osa(t, w[:n]) <= edits(t) for t in stems for n in range(len(w)))
        assert bool(lex.kind(w)) == near, w


def test_misspelled_terms_of_all_kinds_are_found():
    lex = toxicity.Lexicon(frozenset(["idiot", "stupid", "scum", "worthless"]), frozenset(["moro"]))
    for w in ("idoit", "iidot", "scmu", "scun", "skum", "worhtles", "worhtlses", "mroons", "mooronic"):
        assert lex.kind(w) >= 3, w
        assert toxicity.features(f"you {w} there", lex) != (0.0,) * len(toxicity.MEASURES), w
    for w in ("idi0t", "st*pid", "id10t", "$tup1d", "i.d.i.o.t", "s_c_u_m", "5cum", "scu*", "w0rthl3ss", "m0r0ns"):
        assert toxicity.features(f"you {w} there", lex) != (0.0,) * len(toxicity.MEASURES), w
    for w in ("well-known", "3rd", "10", "a.b", "there", "wonderful"):
        assert toxicity.features(f"you {w} see", lex) == (0.0,) * len(toxicity.MEASURES), w


def test_quotation_is_told_from_abuse():
    said = 'he called it "trash talk" and left the room again with them all'
    i = said.index("trash")
    assert toxicity.quoted(said, i, i + 5)
    plain = "you are trash and he said \"hello there friend\" to all"
    i = plain.index("trash")
    assert not toxicity.quoted(plain, i, i + 5)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in catalog.op9_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [d for d in toxic if rows[d].held_out]
    bad, clean = [d for d in held if toxic[d]], [d for d in held if not toxic[d]]
    pairs = [(rows[a].score > rows[b].score) + 0.5 * (rows[a].score == rows[b].score) for a in bad for b in clean]
    assert sum(pairs) / len(pairs) > 0.8
    assert sum(rows[d].predicted for d in clean) <= 0.02 * len(clean)


def test_held_out_labels_are_not_used(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score_documents(docs, other).collect()}


def test_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, None), (None, 1, 1), (5, None, 0), (99, 1, 1), (8, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    wide = clash(docs, "score", "toxic", "predicted", "held_out")
    rows = toxicity.score_documents(wide, labels).collect()
    assert len(rows) == docs.count() and all(r.score is not None for r in rows)
    kept = toxicity.keep(wide, labels)
    assert kept.columns == wide.columns
    assert toxicity.score_documents(no_docs, labels).collect() == []
    assert len(toxicity.score_documents(docs, labels.limit(0)).collect()) == docs.count()
