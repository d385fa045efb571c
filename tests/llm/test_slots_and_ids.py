"""Slots of a packing plan, rows that share an id, and items without one."""

import numpy as np

from accordant.llm import ngram_join, pattern_packing, spaced_seed


def test_every_rank_has_one_slot_in_its_block():
    rng = np.random.default_rng(4)
    histogram = np.zeros(65, dtype=np.int64)
    histogram[1:64] = rng.integers(0, 400, 63)
    slots = pattern_packing.plan_rows(pattern_packing.plan_packing(histogram, 64))
    widths, rows = pattern_packing.slot_blocks(slots)
    width, by_block = dict(widths), {}
    for length, block, low, high, *_ in rows:
        by_block.setdefault((length, block), []).append((low, high))
    for length in np.flatnonzero(histogram):
        for rank in range(histogram[length]):
            assert sum(low <= rank < high for low, high in by_block[length, rank // width[length]]) == 1
    assert len(rows) <= 2 * len(slots) + 64 and pattern_packing.slot_blocks([]) == ([], [])


def test_rows_that_share_an_id_but_not_a_text(spark):
    texts = ["one two three four five six seven", "quite other words stand in this text", "and a third one that is its own"]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (2, texts[2], "x"), (2, texts[2], "y"), (3, texts[0], "x"), (4, "", "x"), (5, None, "x"), (None, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ngram_id string").repartition(3)
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (4, ""), (5, ""), (0, texts[0])])


def test_items_without_an_id_are_none(spark):
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, words)], "item_id long, text string")
    assert spaced_seed.contaminated(docs, bench).count() == 0
