"""Repeated passages counted in words, and the columns of a user's table, against plain versions."""

import collections
import random
import re

from accordant.llm import bwt_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_passages_against_all_windows_of_words(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [make(rng.randint(45, 70)) for _ in range(6)]
    texts = [" ".join(make(rng.randint(0, 40)) + rng.choice(shared) + make(rng.randint(0, 40))) for _ in range(40)]
    texts += [" ".join(make(60) * 2), texts[0], texts[0].replace(" ", "\n"), "", None, " ".join(["a"] * 120), " ".join(shared[0])]
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[k : k + 51]) for w in words for k in range(len(w) - 50))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in bwt_dedup.removal_digests(docs, words=51).collect()}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 50):
            if seen[tuple(w[k : k + 51])] > 1:
                gone[k : k + 51] = [True] * 51
        assert got[i] == (sum(a and not b for a, b in zip(gone, [False, *gone], strict=False)), sum(gone)), i


def test_columns_of_any_name_stay(spark):
    rows = [(1, "x" * 500, "a", 1, None, 2), (2, "y" + "x" * 500, "b", None, "s", 3), (3, None, None, 1, "s", 4)]
    docs = spark.createDataFrame(rows, "k1 long, text string, whole string, place int, spans string, row long")
    for words in (None, 51):
        out = bwt_dedup.without_repeats(docs, words=words)
        assert out.columns == docs.columns
        assert sorted((r.k1, r.text, r.whole, r.place, r.spans, r.row) for r in out.collect()) == [(2, "y", "b", None, "s", 3), (3, "", None, 1, "s", 4)]
    assert bwt_dedup.without_repeats(docs.limit(0), words=51).count() == 0
