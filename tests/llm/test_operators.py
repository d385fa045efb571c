"""Each corpus operator against a plain version of it, on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import bwt_dedup, bwt_intervals, license_scan, ngram_join, page_extract, pattern_packing, quality_rules, recurrent_lm, shared, spaced_seed, subword_classifier, token_frames

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def _texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(120), make(90)
    out = [make(rng.randint(1, 150)) for _ in range(25)]
    out += [make(30) + "\n" + passage + " " + make(10), make(5) + passage, base, base, base + " tail", base.replace(" ", "  ", 1), base.upper()]
    out += ["", None, " \n\t ", "one", "a b c", "a b c", "aaaa " * 300, "x" * 900, make(9000), "line\nline\nother line\nline", "MIT.\nReleased under the MIT License.\n" + make(8)]
    near = base.split()
    near[40] = "changed"
    return [*out, " ".join(near), " ".join(near[:-3])]


TEXTS = _texts()


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", 7, 8) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, component_id long, key long").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(len(TEXTS))] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _set(text, n):
    words = WORD.findall(_lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_components(documents, n, percent):
    sets = [_set(t, n) for t in TEXTS]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(documents.select("doc_id", "text"), n, percent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_light_subsets_find_exactly_the_links():
    for percent in (80, 85):
        for a in range(1, 15):
            for b in range(a, 15):
                c = ngram_join.needed(a, b, percent)
                assert (100 * c >= percent * (a + b - c)) and not (100 * (c - 1) >= percent * (a + b - c + 1))
                if c <= a:
                    assert c in ngram_join.subset_sizes(a, 14, percent) and c in ngram_join.subset_sizes(b, 14, percent)


def test_ngram_links_are_all_true_links(spark):
    rng = random.Random(23)
    base = [f"{rng.randint(0, 10**9):x}" for _ in range(120)]
    texts = []
    for i in range(12):  # a chain of near copies: neighbours link, the ends don't
        texts.append(" ".join(["x%d" % k for k in range(4 * i)][-4:] + base[4 * i :] + ["y%d" % k for k in range(4 * i)]))
    texts += [texts[0], texts[0] + " tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for n, percent in ((4, 85), (5, 80)):
        sets = [_set(t, n) for t in texts]
        first = {s: i for i, s in reversed(list(enumerate(sets)))}
        expected = {(a, b) for a in first.values() for b in first.values() if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        members, links = ngram_join.ngram_links(docs, n, percent)
        got = [(r.a, r.b) for r in links.collect()]
        assert set(got) == expected and len(got) == len(expected) > 10
        assert {r.doc_id: r.rep for r in members.collect()} == {i: first[s] for i, s in enumerate(sets)}


def test_ngram_empty_and_repeated_rows(spark, nothing):
    assert ngram_join.ngram_components(nothing).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.ngram_components(df).collect()) == [(0, 1), (1, 1), (1, 1), (3, 1)]
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each_group(df).collect()) == [0, 1]


def test_repeats_against_all_windows(documents):
    raw = [(t or "").encode() for t in TEXTS]
    length = 400
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for limit in (bwt_dedup.GROUP, 1):
        bwt_dedup.GROUP, kept = limit, bwt_dedup.GROUP
        try:
            got = {r.doc_id: tuple(r)[1:] for r in bwt_dedup.removal_digests(documents, length).collect()}
        finally:
            bwt_dedup.GROUP = kept
        for k, b in enumerate(raw):
            gone = np.zeros(len(b), dtype=bool)
            for i in range(len(b) - length + 1):
                if seen[b[i : i + length]] > 1:
                    gone[i : i + length] = True
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            assert got[k] == (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()), k
    cut = bwt_dedup.without_repeats(documents)
    assert cut.columns == documents.columns and all(len(r.text.encode()) <= len(raw[r.doc_id]) for r in cut.collect())


def test_pipeline_cuts_repeated_passages_of_51_words(spark):
    import corpus_pipeline

    rng = random.Random(9)
    make = lambda n: [f"{rng.randint(0, 10**6):x}" for _ in range(n)]
    passage, shorter = [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(51)], make(50)
    parts = {i: (make(30), make(30)) for i in range(4)}
    texts = {0: [*parts[0][0], *passage, *parts[0][1]], 1: [*parts[1][0], *passage, *parts[1][1]], 2: [*parts[2][0], *shorter, *parts[2][1]], 3: [*parts[3][0], *shorter, *parts[3][1]], 4: make(5) + passage + ["é" * 220] * 1, 5: ["é" * 220, "end"]}
    texts = {i: " ".join(t) for i, t in texts.items()} | {6: None, 7: " \n" + "\n".join(passage) + "  "}
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts.items()], "doc_id long, text string, n_chars int").repartition(3)
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6}
    for i in (0, 1):
        assert got[i].text.split() == parts[i][0] + parts[i][1] and got[i].n_chars == len(got[i].text)
    assert got[2].text == texts[2] and got[3].text == texts[3]
    assert got[4].text.split() == texts[4].split()[:5] and got[5].text == " end"


def test_intervals_against_sorted_suffixes():
    rng = np.random.default_rng(1)
    for depth in (2, 5, 16):
        text = np.append(rng.integers(1, 4, 300), 0)
        order = bwt_intervals.sort_suffixes(text, depth)
        below = bwt_intervals.shared_below(text, order, depth)
        for i in range(1, len(text)):
            a, b = text[order[i - 1] : order[i - 1] + depth], text[order[i] : order[i] + depth]
            if 0 not in a and 0 not in b and len(a) == len(b) == depth:
                assert below[i] == (a.tolist() != b.tolist())


def _ids(end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in TEXTS]


def test_token_files(spark, documents, nothing, tmp_path):
    want, at = [], 0
    for i, ids in enumerate(_ids(0)):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_frames.token_digests(documents, TOKENIZER, 0).collect())) == want
    assert token_frames.token_digests(nothing, TOKENIZER, 0).count() == 0
    path = tmp_path / "x.zst"
    with path.open("wb") as out:
        writer = token_frames.FrameWriter(out)
        token_frames.FRAME_TOKENS, kept = 50, token_frames.FRAME_TOKENS
        try:
            for i, ids in enumerate(_ids(70000)):
                writer.add(i, ids)
            writer.finish()
        finally:
            token_frames.FRAME_TOKENS = kept
    import pyarrow.fs

    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as file:
        reader = token_frames.FrameReader(file)
        assert len(reader.frames) > 3
        assert {i: t.tolist() for i, t in reader.documents({3, 40})} == {i: _ids(70000)[i].tolist() for i in (3, 40)}
    spoiled = bytearray(path.read_bytes())
    spoiled[reader.frames[0].packed // 2] ^= 255
    path.write_bytes(bytes(spoiled))
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as file, pytest.raises((ValueError, Exception)):
        token_frames.FrameReader(file).frame(0)


def test_packing(documents, nothing):
    rows = pattern_packing.pack_documents(documents, TOKENIZER, 2, capacity=64).collect()
    by_doc, by_sequence, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        total += r.length
    for i, ids in enumerate(_ids(2)):
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 64)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids) and len(by_doc[i]) == -(-len(ids) // 64)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_sequence) <= -(-total // 64) + 3
    assert pattern_packing.pack_documents(nothing, TOKENIZER, 2).count() == 0


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(2)
    for high in (1, 50, 5000):
        histogram = np.zeros(129, dtype=np.int64)
        histogram[1:128] = rng.integers(0, high + 1, 127)
        used = np.zeros_like(histogram)
        for pattern, repeats in pattern_packing.plan_packing(histogram, 128):
            assert sum(x * m for x, m in pattern) <= 128 and repeats > 0
            for x, m in pattern:
                used[x] += m * repeats
        assert (used == histogram).all()


def test_base_counts(documents, labels, nothing):
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents, labels).collect()}
    for i, t in enumerate(TEXTS):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        runs = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = {k + j for k in range(len(words) - 7) if runs[tuple(words[k : k + 8])] > 1 for j in range(8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(again))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert {round(r.quality_score, 6) for r in quality_rules.quality_rules(documents, labels.limit(0)).collect()} == {0.5}


def _junk(spark, n=240):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(25, 60))]
        rows.append((i, " ".join(w.upper() + "!!" for w in text) if i % 3 == 0 else " ".join(text), int(i % 3 > 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_classifiers_on_held_out_rows(spark):
    df = _junk(spark)
    learned, labels = df.where("doc_id < 160"), df.select("doc_id", "quality")
    good = {r.doc_id: r.quality for r in labels.collect()}
    scores = {r.doc_id: r.score for r in subword_classifier.subword_scores(df, learned, labels).collect()}
    assert all((scores[i] >= 0.3) == good[i] for i in range(160, 240))
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(df, labels.where("doc_id < 160")).collect()}
    assert sum(kept[i] == bool(good[i]) for i in range(160, 240)) >= 78
    left = quality_rules.without_rejected(df, labels)
    assert left.columns == df.columns and 0 < left.count() < df.count()


def test_language_model(spark, documents, nothing):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    held = shared.id_fold(F.col("doc_id")) == 1
    tokens = [[*WORD.findall(_lower(t)), None] for t in TEXTS]
    counts = collections.Counter(w for i, t in enumerate(tokens) if fold(i) != 1 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    results = [{r.doc_id: r for r in recurrent_lm.score_documents(documents, held, lookup).collect()} for lookup in (recurrent_lm.LOOKUP, 20)]
    for i, t in enumerate(tokens):
        r = results[0][i]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(t), sum(counts[w] > 0 for w in t), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
        assert results[1][i].n_known == r.n_known and abs(results[1][i].base_score - base) < 1e-6 * max(1, abs(base))
    assert recurrent_lm.score_documents(nothing, held).count() == 0


def test_weights_come_from_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "WARM_DOCUMENTS", 1)
    first = spark.range(4).orderBy(F.xxhash64("id"), "id").first()[0]  # the document that is warmed up on
    texts = {i: "a b " * 400 if i == first else "c d " * 6000 for i in range(4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    vocabulary = recurrent_lm.build_vocabulary(recurrent_lm.count_words(docs))
    judged = iter(range(-9, 0))  # whatever is judged on the sample, the average does worse
    with monkeypatch.context() as patch:
        patch.setattr(recurrent_lm, "log_probabilities", lambda *_: np.array([next(judged)]))
        net = recurrent_lm.train(docs, vocabulary)
    data = np.frombuffer(b"c d " * 50, np.uint8)
    code, ending, edges = recurrent_lm._tokens(data, np.array([0, len(data)]))
    loss = -recurrent_lm.log_probabilities(net, vocabulary.classes(code, ending), edges, vocabulary.end_class)
    assert np.median(loss) < 0.2


def test_gradient_of_the_recurrent_network():
    from accordant.llm import gated_network as g

    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in g.new_network(5, 3, np.full(5, 0.2)).items()}
    classes, offsets = rng.integers(0, 5, 12), np.array([0, 7, 12])
    trainer = g.Trainer(net, 0, length=12)
    caught = {}
    trainer._update = lambda grad: caught.update(grad)
    trainer.learn(classes, offsets, most_lanes=2)
    for k in ("recur", "embed", "output", "bias"):
        at = tuple(s // 2 for s in net[k].shape)
        losses = []
        for step in (1e-4, -1e-4):
            moved = {n: v.copy() for n, v in net.items()}
            moved[k][at] += step
            losses.append(-g.log_probabilities(moved, classes, offsets, 0).astype(np.float64).mean())
        assert abs((losses[0] - losses[1]) / 2e-4 - caught[k][at]) < 2e-2, k


def test_spaced_seeds(spark, documents):
    items = [" ".join((TEXTS[0] + " " + TEXTS[1] + " " + TEXTS[2]).split()[:30]), "short one", None, ""]
    words = items[0].split()
    words[4], words[15] = "other", "another"
    cases = {0: "before " + items[0] + " after", 1: "x " + " ".join(words), 2: " ".join(words[:12]), 3: None, 4: "", 5: " ".join(words[5:] + ["y"] * 5)}
    docs = spark.createDataFrame([(i, t, "z") for i, t in cases.items()], "doc_id long, text string, seed string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): r.n_matched for r in spaced_seed.contaminated(docs, bench).collect()}
    assert set(found) == {(0, 0), (1, 0), (5, 0)} and found[0, 0] == 30 and found[1, 0] == 28
    spaced_seed.BROADCAST_ROWS, kept = 0, spaced_seed.BROADCAST_ROWS
    try:
        assert {(r.doc_id, r.item_id): r.n_matched for r in spaced_seed.contaminated(docs, bench).collect()} == found
    finally:
        spaced_seed.BROADCAST_ROWS = kept
    assert sorted(r.doc_id for r in spaced_seed.without_contaminated(docs, bench).collect()) == [2, 3, 4]
    assert spaced_seed.contaminated(docs, bench.limit(0)).count() == 0 and spaced_seed.contaminated(docs.limit(0), bench).count() == 0


def test_passages_of_items(spark):
    rng = random.Random(17)
    make = lambda n: [f"{rng.randint(0, 10**9):x}" for _ in range(n)]
    long, item, short = make(200), make(30), make(6)
    cases = {
        0: make(20) + long[50:140] + make(20),  # 90 words of 200
        1: make(5) + item[:10] + make(1) + item[10:20] + make(1) + item[20:] + make(5),  # two words put in
        2: make(4) + item[:9] + item[10:20] + make(9),  # one word left out
        3: item[:10] + make(40) + item[20:],  # pieces far apart
        4: make(10) + short + make(10),
        5: make(10) + short[:5] + make(10),
        6: make(10) + item[:12] + make(40),
        7: make(80),
        8: make(3) + long[:13] + make(3),
        9: make(3) + long[:12] + make(3),
    }
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in cases.items()] + [(None, " ".join(long[:30])), (10, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((long, item, short))] + [(3, None)], "item_id long, text string")
    for rows in (spaced_seed.BROADCAST_ROWS, 0):
        spaced_seed.BROADCAST_ROWS, kept = rows, spaced_seed.BROADCAST_ROWS
        try:
            assert {r.doc_id for r in spaced_seed.without_contaminated(docs, bench).collect()} == {5, 6, 7, 9, 10}
        finally:
            spaced_seed.BROADCAST_ROWS = kept


PAGE = "<html><head><title>t</title></head><body><nav>menu</nav>{0}<div class='ad'>buy</div><article><h1>{1} &amp; co</h1><p>one <b>two</b>three<br>four<div class='x1'>share this</div><p>tail{1}</article><footer>f</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE.format("<p>top</p>", i), 1) for i in range(10)]
    rows += [(10, "http://h.example.com/x", None, 1), (11, None, "plain  text", 1), (12, "http://o.example.com/", "<body><div id='cookie-notice'>c</div><main><p>a<p>b<section id=comments>no</section></main>", 1), (13, "?", "", 1), (13, "?", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, code int")
    got = collections.defaultdict(list)
    for r in page_extract.extract_pages(df).collect():
        got[r.page_id].append((r.text, r.n_chars))
    for i in range(10):
        text = f"{i} & co one twothree four tail{i}"
        assert got[i] == [(text, len(text))]
    assert got[10] == [("", 0)] and got[11] == [("plain text", 10)] and got[12] == [("a b", 3)] and got[13] == [("", 0)] * 2
    assert page_extract.extract_pages(df.limit(0)).count() == 0


def test_templates_of_a_large_host_and_at_the_edges_of_articles(spark):
    notice, box = "All stories here are free to read. " * 12, "<div class='x7'>see more</div>"
    big = [(i, f"http://big.example.com/{i}", f"<body>{'<div>from the east desk</div>' if i < 100 else ''}<article><p>Story {i}</p>{box if i < 100 else ''}<p>end {i}</p></article></body>") for i in range(1000)]
    bare = [(1000 + i, f"http://big.example.com/b{i}", f"<body>{'<div>from the east desk</div>' if i < 100 else ''}<p>Plain {i}</p></body>") for i in range(200)]
    small = [(2000 + i, f"http://small.example.com/{i}", f"<body><article><p>{notice}</p><h1>T {i}</h1><div class='q'>{notice}</div><p>same prose</p><p>own {i}</p><p>bye</p></article></body>") for i in range(10)]
    df = spark.createDataFrame(big + bare + small, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_extract.extract_pages(df).collect()}
    assert all(got[i] == f"Story {i} end {i}" for i in range(1000)) and all(got[1000 + i] == f"Plain {i}" for i in range(200))
    assert all(got[2000 + i] == f"T {i} same prose own {i}" for i in range(10))


def test_licenses(spark):
    rows = [
        (1, "a/b/c/f.py", "import x\n# Licensed under the Apache License, Version 2.0.\nx"), (2, "a/b/c/g.py", "nothing here of the kind"), (3, "a/LICENSE", "Released under the MIT License."),
        (4, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (5, "a/z.py", None), (6, "q/z.py", ""), (7, None, "x"), (8, "a/LICENSE-extra/n.py", "y"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, license int")
    got = {r.doc_id: (r.license, r.origin) for r in license_scan.license_scan(df).collect()}
    assert got == {1: ("Apache-2.0", "own"), 2: ("GPL-3.0", "inherited"), 3: ("MIT", "own"), 4: ("GPL-3.0", "own"), 5: ("MIT", "inherited"), 6: (None, "none"), 7: (None, "none"), 8: ("MIT", "inherited")}
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_pipeline_columns(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, TEXTS[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, docs, str(tmp_path)), "stage")
        if name != "best-fit packing":
            assert out.columns == docs.columns and out.count() <= before
            before = out.count()
        docs = out
    assert set(docs.columns) >= {"doc_id", "sequence_id", "offset"} and docs.count() > 0
