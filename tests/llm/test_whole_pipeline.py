"""The pipeline as a whole, each stage's rows against a plain version on what the stage before kept."""

import collections
import random
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCUMENTS = "doc_id long, source string, lang string, n_chars int, text string"


def _tables(spark, folder):
    rng = random.Random(44)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(6000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passage, item, base, long = make(60), make(30), make(150), make(900)
    texts = [make(rng.randint(30, 120)) for _ in range(40)]
    texts += [make(25) + passage + make(25) for _ in range(4)]
    texts += [base, base, [*base[:70], "other", *base[71:]], [*base, "tail"]]
    texts += [make(20) + item + make(20), make(10) + item + make(40)]
    texts += [long, make(2500)]
    good = [" ".join(t) for t in texts]
    good[5] = good[5].replace(" ", "\n", 3)
    junk = [" ".join(rng.choice(["cl1ck", "$$$", "w1n", "n0w", "fr33", "b0nus", "#1", "x9"]) for _ in range(rng.randint(25, 70))) for _ in range(30)]
    rows = [(i, "s%d" % (i % 3), "en", len(t), t) for i, t in enumerate(good + junk)]
    rows += [(900, None, None, 0, ""), (901, "s1", None, None, None), (902, "s2", "en", 3, "too short"), (None, "s1", "en", len(good[0]), good[0]), rows[1]]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < len(good))) for i in range(len(good) + len(junk))]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, None), (2, ""), (3, "yes")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def _key(r):
    return (-1 if r.doc_id is None else r.doc_id, r.text or "")


def _cut(text, strings, passages):
    """The text without strings of 400 bytes and passages of 51 words that stand elsewhere too."""
    gone = [False] * len(text)
    for i in range(len(text) - 399):
        if strings[text[i : i + 400]] > 1:
            gone[i : i + 400] = [True] * 400
    at = [m.start() for m in WORD.finditer(text)]
    words = WORD.findall(text)
    edges = [0, *at[1:], len(text)]
    for k in range(len(words) - 50):
        if passages[tuple(words[k : k + 51])] > 1:
            gone[edges[k] : edges[k + 51]] = [True] * (edges[k + 51] - edges[k])
    return "".join(c for c, g in zip(text, gone, strict=True) if not g)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(benchmark item, rows of the documents and of each stage)."""
    import corpus_pipeline

    folder = str(tmp_path_factory.mktemp("tables"))
    item = _tables(spark, folder)
    found = [spark.read.parquet(f"{folder}/documents.parquet")]
    kept, corpus_pipeline.written = corpus_pipeline.written, lambda df, name: found.append(kept(df, name)) or found[-1]
    try:
        last = corpus_pipeline.run(spark, folder)
    finally:
        corpus_pipeline.written = kept
    assert len(found) == 1 + len(corpus_pipeline.STAGES) and last is found[-1]
    assert all(df.columns == found[0].columns for df in found[:-1])
    return item, [df.collect() for df in found]


def test_quality_rules_keep_good_documents(stages):
    _, rows = stages
    kept = {r.doc_id for r in rows[1]}
    assert {r.doc_id for r in rows[0] if r.doc_id is not None and r.doc_id < 52} <= kept
    assert not kept & {*range(52, 82), 900, 901, 902}
    assert not collections.Counter(map(_key, rows[1])) - collections.Counter(map(_key, rows[0]))


def test_one_of_each_group_of_near_copies_stays(stages):
    _, rows = stages
    # rows without an id all stay, as one_of_each_group says
    before, after = ([r for r in part if r.doc_id is not None] for part in rows[1:3])
    assert [_key(r) for r in rows[1] if r.doc_id is None] == [_key(r) for r in rows[2] if r.doc_id is None]
    after = collections.Counter(map(_key, after))

    def shingles(text):
        words = WORD.findall(text.lower())
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = [shingles(r.text) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    members = collections.defaultdict(list)
    for g, r in zip(group, before, strict=True):
        members[g].append(_key(r))
    assert sorted(map(len, members.values()))[-2:] == [2, 4]
    assert sum(after.values()) == len(members)
    assert all(sum(after[k] for k in set(keys)) == 1 for keys in members.values())


def test_repeats_are_cut(stages):
    _, rows = stages
    strings = collections.Counter(r.text[i : i + 400] for r in rows[2] for i in range(len(r.text) - 399))
    words = [WORD.findall(r.text) for r in rows[2]]
    passages = collections.Counter(tuple(w[k : k + 51]) for w in words for k in range(len(w) - 50))
    want = {r.doc_id: _cut(r.text, strings, passages) for r in rows[2]}
    assert {r.doc_id: r.text for r in rows[3]} == {k: t for k, t in want.items() if t}
    assert sum(len(want[r.doc_id]) < len(r.text) for r in rows[2]) == 4
    assert all(r.n_chars == len(r.text) for r in rows[3])


def test_documents_with_benchmark_items_go(stages):
    item, rows = stages
    holds = {r.doc_id for r in rows[3] if " ".join(item) in r.text}
    assert len(holds) == 2
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in rows[3]} - holds


def test_packed_sequences_hold_every_token(stages):
    tokenizers = pytest.importorskip("tokenizers")
    from accordant.llm.queries import tokenizer_file

    _, rows = stages
    encoder = tokenizers.Tokenizer.from_file(tokenizer_file())
    sizes = {r.doc_id: len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows[4]}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows[5]:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(sizes) and max(sizes.values()) > 1024
    for doc_id, parts in pieces.items():
        at = 0
        for number, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (number, at) and length <= 1024
            at += length
        assert at == sizes[doc_id]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(sizes.values()) // 1024) + 1


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in {"documents": DOCUMENTS, "labels": "doc_id long, quality int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
