"""What the steps of the suffix-array dedup write goes as soon as nothing reads it."""

import random
from pathlib import Path

from accordant.llm import bwt_dedup
from accordant.llm.shared import shared_folder


def test_only_the_verdicts_stay(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "GROUP", 3)  # so that cores are made longer too
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    shared = make(900)
    docs = spark.createDataFrame([(i, make(rng.randint(0, 90)) + shared + make(rng.randint(0, 90))) for i in range(20)], "doc_id long, text string")
    folder = Path(shared_folder(spark))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    rows = bwt_dedup.removal_digests(docs, words=51).collect()
    assert len(rows) == 20 and all(r.n_removed >= 900 for r in rows)
    assert {p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before and p.is_dir()} == {"all-repeats"}
