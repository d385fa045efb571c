"""Learned scores of quality against plain versions: features listed one at a time, vectors averaged, logits by hand."""

import collections
import math
import random
import re

import numpy as np

from accordant.llm import labelled, ngram_features, quality_rules, subword_classifier
from accordant.llm.shared import find_words, mix

WORD = re.compile("[^\x20\x09-\x0d]+")
QUARTER = 1 << (ngram_features.BITS - 2)
SPREAD, AGAIN = 0x9E3779B1, 0x85EBCA77  # fixed values of the hash of character n-grams


def _code(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return find_words(data, np.array([0, len(data)]), lower=False).code[0]


def _pair(a, b):
    if a == b:
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([_code(a)], np.uint64) * np.uint64(0x9FB21C651E98DF25) + _code(b))[0])


def _characters(gram):
    code = 0
    for c in gram:
        code = (code * 0x01000193 + (32 if c in " \t\n\v\f\r" else ord(c))) % 2**32
    code = code * SPREAD % 2**32
    code ^= code >> 15
    return code * AGAIN % 2**32


def plain_features(text):
    """bucket -> weight; words, pairs and n-grams of 3 and 4 code points have a quarter each."""
    text = text or ""
    words = WORD.findall(text)
    high = lambda code: int(code) >> (66 - ngram_features.BITS)
    kinds = [[high(_code(w)) for w in words], [high(_pair(a, b)) + QUARTER for a, b in zip(words, words[1:], strict=False)]]
    for n in (3, 4):
        grams = [text[i : i + n] for i in range(len(text) - n + 1)]
        kinds.append([(_characters(g) >> (34 - ngram_features.BITS)) + QUARTER * (n - 1) for g in grams if not re.search("[ \t\n\v\f\r]", g[1:-1])])
    out = collections.Counter()
    for kind in kinds:
        for bucket in kind:
            out[bucket] += 0.25 / len(kind)
    return out


def _texts():
    rng = random.Random(21)
    good = ["harbour", "lantern", "meadow", "écluse", "granite", "willow", "ferry", "orchard"]
    bad = ["cl1ck", "w1n", "$$$", "fr33", "b0nus", "日本", "!!!", "n0w"]
    out = [(" ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randint(22, 60))), int(i % 3 > 0)) for i in range(90)]
    odd = ["", None, " \n\t ", "one", "a  b", "ab cd", "é" * 500, "harbour " * 300, "x" * 30000, "same same same same", "w1n\r\nw1n"]
    return out + [(t, None) for t in odd] + [out[0], out[1]]


def _tables(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, i, "z", 0.5) for i, (t, _) in enumerate(texts)] + [(None, "no id", 1, None, None)], "doc_id long, text string, bucket int, quality string, score double").repartition(3)
    labels = spark.createDataFrame([(i, q, "x") for i, (_, q) in enumerate(texts) if q is not None] + [(3, None, "x"), (None, 1, None)], "doc_id long, quality int, text string")
    return [*[t for t, _ in texts], "no id"], docs, labels


def test_features_of_labelled_rows(spark):
    texts, docs, labels = _tables(spark)
    rows = labelled.labelled_sample(docs, labels, "quality", 4000)
    assert [r[0] for r in rows] == [i for i in range(len(texts) - 1) if i < 90 or i > 100]
    for doc_id, _, index, weight in rows:
        want = plain_features(texts[doc_id])
        got = collections.Counter()
        for k, w in zip(index.tolist(), weight.tolist(), strict=True):
            got[k] += w
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want), doc_id


def test_subword_scores_by_averaged_vectors(spark, monkeypatch):
    texts, docs, labels = _tables(spark)
    models = []
    fit = subword_classifier.fit_subwords
    monkeypatch.setattr(subword_classifier, "fit_subwords", lambda rows: models.append(fit(rows)) or models[-1])
    got = {r.doc_id: r.score for r in subword_classifier.subword_scores(docs, docs, labels).collect()}
    model = models[0]
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        mean = np.zeros(model.vectors.shape[1])
        for bucket, weight in plain_features(text).items():
            mean += weight * model.vectors[bucket].astype(np.float64)
        z = mean @ model.output.astype(np.float64) + model.bias
        want = math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1]))
        assert abs(got[i if i < len(texts) - 1 else None] - want) < 1e-4, i
    assert min(got[i] for i in range(90) if i % 3) > max(got[i] for i in range(90) if i % 3 == 0)


def test_kept_by_sums_of_weights(spark, monkeypatch):
    texts, docs, labels = _tables(spark)
    models = []
    fit = quality_rules.fit_logistic
    monkeypatch.setattr(quality_rules, "fit_logistic", lambda rows: models.append(fit(rows)) or models[-1])
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    kept = [r.doc_id for r in quality_rules.without_rejected(docs, labels).collect()]
    model = models[0]
    assert sorted(-1 if k is None else k for k in kept) == sorted(-1 if k is None else k for k, r in got.items() if r.kept)
    for i, text in enumerate(texts):
        r = got[i if i < len(texts) - 1 else None]
        total = sum(weight * float(model.table[bucket]) for bucket, weight in plain_features(text).items())
        want = 1 / (1 + math.exp(-min(40, max(-40, model.slope * total + model.offset))))
        words = WORD.findall(text or "")
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        assert abs(r.quality_score - want) < 1e-4 and r.base_failed == failed, i
        assert r.kept == (not failed and r.quality_score >= 0.5), i
    assert all(got[i].kept == (i % 3 > 0) for i in range(90) if not got[i].base_failed)
