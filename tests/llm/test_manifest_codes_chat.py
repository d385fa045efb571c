"""Merkle manifest, vector codes and chat formatting against plain versions, on tables with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import chat_format, code_compression, merkle_manifest
from accordant.llm.shared import id_fold

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def _path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return out


def _plain_manifest(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for s in order}
    trees = {s: _tree([_leaf(r) for r in ordered[s]]) for s in order}
    top = _tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, row in enumerate(ordered[s]):
            steps = _path(trees[s], i) + _path(top, k)
            claimed = row
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0 and row[4] is not None:
                claimed = (*row[:4], row[4].translate(str.maketrans(UPPER, LOWER)))
            x = _leaf(claimed)
            for before, after in steps:
                x = _h(*before, x, *after)
            out.append((row[0], _leaf(row), trees[s][-1][0], top[-1][0], _h(*(n for b, a in steps for n in (*b, *a))), x, x == top[-1][0]))
    return out


def _manifest(docs, **more):
    return merkle_manifest.merkle_manifest(docs, "doc_id", "source", COLUMNS, claimed={"text": F.translate("text", UPPER, LOWER)}, where=id_fold(F.col("doc_id")) == 0, **more)


def _rows(n_sources, n, rng):
    texts = ["", None, "Words In Capitals", "none", "é" * 50, "Long " * 5000]
    return [(i, rng.choice([None, "Ä", "z", "a", *(f"s{k}" for k in range(n_sources))]), rng.choice([None, "en", ""]), rng.choice([None, 0, 12]), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize(("n_sources", "n"), [(1, 40), (30, 200), (300, 700)])
def test_manifest_against_a_plain_version(spark, n_sources, n):
    rng = random.Random(n)
    rows = _rows(n_sources, n, rng)
    rows += [rows[3], rows[3], (rows[5][0], rows[5][1], "xx", 1, "other text of the same id"), (None, "a", None, None, None), (None, None, "en", 3, "T")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x", 9) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, part int, leaf string, sid long").repartition(3)
    got = [tuple(r) for r in _manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(_plain_manifest(rows), key=repr)


def test_manifest_of_a_source_with_many_buckets(spark):
    rows = [(i, "hot" if i % 10 else "cold", "en", i, f"Text {i}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = _manifest(docs.repartition(5), proofs=True).collect()
    assert sorted(tuple(r)[:7] for r in out) == sorted(_plain_manifest(rows))
    row = next(r for r in out if r.doc_id == 7777)
    x = row.leaf
    for step in row.proof:
        x = _h(step.before, x, step.after) if step.before or step.after else x
    assert x == row.root and len(row.proof) == 5


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert _manifest(spark.createDataFrame([], schema)).collect() == []
    row = (5, "only", "en", 1, "ABC")
    assert [tuple(r) for r in _manifest(spark.createDataFrame([row], schema)).collect()] == _plain_manifest([row])


def _plain_codes(vectors):
    """Lloyd's rounds with everything added up anew."""
    kept = sorted((i, [int(np.floor(4096 * np.float64(x))) for x in v], label) for i, v, label in vectors)
    width = len(kept[0][1]) // 8
    parts = np.array([v for _, v, _ in kept]).reshape(len(kept), 8, width)
    books = parts[:16].transpose(1, 0, 2).copy()
    for last in [False] * 6 + [True]:
        far = ((parts[:, :, None, :] - books.transpose(0, 1, 2)[None]) ** 2).sum(-1)
        codes = far.argmin(-1)
        if not last:
            for p in range(8):
                for e in range(books.shape[1]):
                    own = parts[codes[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    errors = far.min(-1).sum(-1)
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + int(e)
    digest = _h(",".join(map(str, books.reshape(-1).tolist())))
    return sorted((i, "".join(f"{c:02x}" for c in codes[k]), int(errors[k]), by_label[label], digest) for k, (i, _, label) in enumerate(kept))


@pytest.mark.parametrize(("n", "dim"), [(400, 16), (9, 8), (300, 64)])
def test_codes_against_a_plain_version(spark, n, dim):
    rng = np.random.default_rng(n)
    vectors = [(i, np.float32(rng.normal(size=dim) * (1 + i % 3)).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(n).tolist()]
    vectors += [(n + k, vectors[0][1], 1) for k in range(n // 3)]  # ties and copies
    odd = [(-1, None, 1), (-2, [*[0.0] * (dim - 1), None], 1), (-3, [float("nan")] * dim, 2), (-4, [float("inf")] * dim, 2), (-5, [-float("inf")] + [1.0] * (dim - 1), None), (-6, [], 1), (-7, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(i, v, label, b"x", 1) for i, v, label in vectors + odd], "vec_id long, embedding array<float>, label int, code binary, error int").repartition(3)
    got = sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in code_compression.code_digests(df).collect())
    assert got == _plain_codes(vectors)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert code_compression.code_digests(spark.createDataFrame([], schema)).count() == 0
    assert code_compression.code_digests(spark.createDataFrame([(1, None, "a"), (2, [float("nan")], None)], schema)).count() == 0
    rows = spark.createDataFrame([(1, [1e300, -1e300, 0.5], "a"), (None, [1.0, 2.0, 3.0], None), (1, [0.0, 0.0, 0.0], "a")], schema)
    out = code_compression.code_digests(rows).collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: (r.vec_id is None, r.code))] == [1, 1, None] and all(r.error == 0 and r.label_error == 0 for r in out)


def test_changes_alone_keep_the_sums():
    rng = np.random.default_rng(0)
    parts, before, after = rng.integers(-99, 99, (50, 8, 4)), rng.integers(0, 5, (50, 8)).astype(np.uint8), rng.integers(0, 5, (50, 8)).astype(np.uint8)
    first, second, change = (code_compression._Deltas(5, 4) for _ in range(3))
    first.add(parts, None, before)
    second.add(parts, None, after)
    change.add(parts, before, after)
    assert (first.sums + change.sums == second.sums).all() and (first.rows + change.rows == second.rows).all()
    same = code_compression._Deltas(5, 4)
    same.add(parts, after, after)
    assert same.packed() == []


CHAT = "</s>[INST] ok [/INST]"


def _plain_chat(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort()
        learned = "".join(t for *_, role, t in turns if role == "assistant")
        state, rejected = "start", None
        for k, (*_, role, _) in enumerate(turns):
            state = {"start system": "told", "start user": "asked", "told user": "asked", "asked assistant": "answered", "answered user": "asked"}.get(f"{state} {role}")
            if state is None:
                rejected = k
                break
        out[conv] = (len(turns), _h(*(f"{role}\n{t}\n" for *_, role, t in turns)), len(learned), _h(learned), state in ("asked", "answered"), rejected)
    return out


def test_chat_against_a_plain_version(spark):
    rng = random.Random(8)
    bits = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "\\\\", "[", "<", "[\\INST]", "<\\\\/s>", " ", "\n", "ok", "é", "[SYS] ", "[/TURN]\n", "[ROLE] ", " [/ROLE] ", "$1", "😀"]
    text = lambda: rng.choice([None, "", CHAT, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])
    roles = ["user", "assistant", "system", "tool", None, "", "[INST] user"]
    rows = [(-1, 0, "user", CHAT), (-1, 1, "assistant", CHAT)]
    for conv in range(60):
        order = ["system"] * (conv % 3 == 0) + ["user", "assistant"] * rng.randint(1, 5)
        rows += [(conv, k, rng.choice(roles) if conv % 4 == 1 else role, text()) for k, role in enumerate(order)]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (7, 0, "user", "x"), (7, 0, "user", "x"), (99, 0, "assistant", "long [INST] \\ " * 40_000)]
    rows += [(98, k, ("user", "assistant")[k % 2], "t") for k in range(700)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, loss int").repartition(3)
    formatted = chat_format.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.rejected_turn) for r in chat_format.chat_digests(formatted).collect()}
    assert got == _plain_chat(rows)
    pieces = {r.conv_id: r.segments for r in formatted.collect()}
    controls = chat_format.INSTRUCTIONS.controls
    for conv in (-1, 3):
        texts = [s.text for s in pieces[conv] if s.loss]
        assert texts and not any(c in t for c in controls for t in texts)
    assert "".join(s.text for s in pieces[-1]) == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]\n<s> <\\/s>[\\INST] ok [\\/INST] </s>\n"
    assert "Python" not in formatted._jdf.queryExecution().toString()


def test_chat_of_no_rows_and_templates_that_lose_texts(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.chat_digests(chat_format.format_conversations(empty)).count() == 0
    good = dict(moves={("start", "user"): "end"}, start="start", ends=frozenset({"end"}))
    for controls, turn in ((("<a", "<<a"), chat_format.Turn("<a ", " <a")), (("<a>",), chat_format.Turn("<a>", " <a>")), (("<a>",), chat_format.Turn("hello ", " <a>")), (("<\\a",), chat_format.Turn("<a> ", " <a>"))):
        with pytest.raises(ValueError):
            chat_format.ChatTemplate(turns={"user": turn}, controls=controls, **good)
