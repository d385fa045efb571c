"""Repeats whose cores stand between very many different flanks, against all windows."""

import collections
import random

import pytest

from accordant.llm import bwt_dedup


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_cores_with_more_flanks_than_a_task_takes(spark, monkeypatch, limit):
    rng = random.Random(31)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, near, far = letters(380), letters(25), letters(60)
    texts = [letters(rng.randint(0, 50)) + core + letters(rng.randint(0, 50)) for _ in range(40)]
    texts += [letters(20) + near + core + near[:rng.randint(0, 25)] + letters(20) for _ in range(40)]  # half of the flanks is shared
    texts += [far + core + letters(9), letters(3) + far + core, core + far, core + far + "é" * 9, core + core, "", None]
    texts += texts[:3]
    monkeypatch.setattr(bwt_dedup, "GROUP", limit)
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in bwt_dedup.removal_digests(docs).collect()}
    for k, b in enumerate(raw):
        gone = [False] * len(b)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        assert got[k] == (sum(gone), sum(x and not y for x, y in zip(gone, [False, *gone], strict=False))), k
