"""Short phrases that many texts share, but no string that goes, make no bins."""

import random

from accordant.llm import bwt_dedup
from accordant.llm.shared import Tables


def test_shared_phrases_make_no_bins(spark, monkeypatch):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrases = [make(60) for _ in range(50)]
    docs = spark.createDataFrame([(i, "".join(rng.choice(phrases) + make(20) for _ in range(15))) for i in range(30)], "doc_id long, text string")
    rows = {}
    write = Tables.write

    def counted(self, df, name, row_group=None):
        out = write(self, df, name, row_group)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Tables, "write", counted)
    bwt_dedup.repeated_spans(docs)
    assert rows["anchors"] == rows["bins"] == rows["repeats"] == 0
