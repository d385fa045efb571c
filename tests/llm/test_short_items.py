"""Benchmark items of a few words: what is quoted goes, what just says the same words stays."""

from accordant.llm import spaced_seed


def test_short_items(spark):
    items = ["Yes", "Not at all!", "Paris. Rome.", "the capital of the country", "a bridge over the old river", None, "", "Yes"]
    texts = {
        0: "He said yes and went.", 1: "Was it so?\nYes\nThen on.", 2: "  YES! ", 3: "I do not mind at all, not at all of it.", 4: "Was it hard? Not at all. On we went.",
        5: "We saw both. Paris. Rome. Then home.", 15: "We saw Paris. Rome. Then home.", 6: "Paris Rome", 7: "Rome. Paris.", 8: "It is the capital of the country by law.", 9: "1\nThe capital of the country\n2", 10: "they built a Bridge over the old river there",
        11: "", 12: None, 13: "...", 14: "x " * 30_000 + ". Not at all.",
    }
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(2, "yes", 1)], "doc_id long, text string, parts int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for rows in (spaced_seed.BROADCAST_ROWS, 0):
        spaced_seed.BROADCAST_ROWS, kept = rows, spaced_seed.BROADCAST_ROWS
        try:
            got = sorted(r.doc_id for r in spaced_seed.without_contaminated(docs, bench).collect())
        finally:
            spaced_seed.BROADCAST_ROWS = kept
        assert got == [0, 1, 3, 7, 11, 12, 13, 15]
