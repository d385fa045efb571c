"""Texts that share half of their words but no link: the pairs that meet grow in proportion to the texts."""

import random

from accordant.llm import ngram_join
from accordant.llm.shared import Tables


def _texts(n, rng):
    common = " ".join(f"footer{k}" for k in range(150))
    own = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(150)) for _ in range(n)]
    return [f"{x} {common}" for x in own]


def test_a_common_footer_brings_no_pairs_together(spark, monkeypatch):
    met = []
    near = ngram_join._near

    def counted(members, pairs, percent):
        met.append(pairs.count())
        return near(members, pairs, percent)

    monkeypatch.setattr(ngram_join, "_near", counted)
    rng = random.Random(1)
    totals = []
    for n in (200, 400):
        texts = _texts(n, rng)
        texts += [texts[0] + " tail", texts[5] + " end"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        met.clear()
        members, _, _ = ngram_join._members_and_edges(Tables(spark), df, 4, 85, every=False)
        totals.append(sum(met))
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df, 4, 85).collect()}
        assert got == {i: i for i in range(n)} | {n: 0, n + 1: 5}
    assert totals[1] <= 4 * 400 and totals[1] < 3 * max(totals[0], 1)
