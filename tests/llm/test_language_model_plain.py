"""Scores of the language model against a plain version, a word at a time in double precision."""

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from accordant.llm import gated_network, recurrent_lm
from accordant.llm.shared import id_fold

WORD = re.compile("[^\x20\x09-\x0d]+")
END = None


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _code(word):
    if word is END:
        return recurrent_lm.END_CODE
    data = np.frombuffer(word.encode(), np.uint8)
    return int(recurrent_lm._tokens(data, np.array([0, len(data)]))[0][0])


def _ending(word):
    raw = word.encode()
    return (raw[-2] if len(raw) > 1 else 0) * 256 + raw[-1]


class Plain:
    """Classes and slots from the counts of words, and probabilities from the weights."""

    def __init__(self, counts, net, one_word, by_ending, slots):
        self.counts, self.net = counts, {k: v.astype(np.float64) for k, v in net.items()}
        order = lambda w: (-counts[w], np.uint64(_code(w)).astype(np.int64))
        frequent = {*sorted(counts, key=order)[:one_word], END}
        self.frequent = {w: k for k, w in enumerate(sorted(frequent, key=_code))}
        total = collections.Counter()
        for w in counts:
            if w not in self.frequent:
                total[_ending(w)] += counts[w]
        classes = one_word + by_ending + 1
        best = sorted(total, key=lambda e: (-total[e], e))[: classes - 1 - len(self.frequent)]
        self.rest = classes - 1
        self.of_ending = {e: len(self.frequent) + k for k, e in enumerate(best)}
        members = collections.defaultdict(list)
        for w in counts:
            if w not in self.frequent:
                members[self.of(w)].append(w)
        self.slot, self.others = {}, collections.defaultdict(list)
        for k, words in members.items():
            words.sort(key=order)
            self.slot |= {w: i for i, w in enumerate(words[: slots - 1])}
            self.others[k] = words[slots - 1 :]

    def of(self, word):
        return self.frequent[word] if word in self.frequent else self.of_ending.get(_ending(word), self.rest)

    def within(self, h, word):
        k = self.of(word)
        if word in self.frequent:
            return 1.0
        logits = h @ self.net["inner"][k] + self.net["inner_bias"][k]
        p = np.exp(logits - logits.max())
        p /= p.sum()
        if word in self.slot:
            return p[self.slot[word]]
        others = self.others[k]
        return p[-1] * (self.counts[word] + 0.5) / (sum(self.counts[w] for w in others) + 0.5 * (len(others) + 1))

    def state(self, h, before):
        w, net = len(h), self.net
        given, own = net["embed"][before] + net["bias"], h @ net["recur"]
        keep, reset = (1 / (1 + np.exp(-(given[i * w : (i + 1) * w] + own[i * w : (i + 1) * w]))) for i in (0, 1))
        candidate = np.tanh(given[2 * w :] + reset * own[2 * w :])
        return keep * h + (1 - keep) * candidate

    def classes(self, h):
        logits = h @ self.net["output"] + self.net["output_bias"]
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def score(self, words):
        h, before, out = np.zeros(self.net["recur"].shape[0]), self.of(END), 0.0
        for word in words:
            h = self.state(h, before)
            before = self.of(word)
            out += math.log10(self.classes(h)[before] * self.within(h, word))
        return out


def _texts(n=90):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(260)]
    # a word tells the next one
    follow = {w: [rng.choice(words) for _ in range(2)] for w in words}
    out = []
    for _ in range(n):
        text = [rng.choice(words[:40])]
        for _ in range(rng.randint(0, 60)):
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.8 else rng.choice(words))
        out.append(" ".join(text))
    return [*out, "", None, " \n ", "Never seen WORDS", out[0], out[0].upper(), "x" * 4000, " ".join(words * 12)]


def test_scores_against_words_one_at_a_time(spark, monkeypatch):
    for name, value in {"FREQUENT_CLASSES": 5, "ENDING_CLASSES": 6, "CLASSES": 12, "SLOTS": 4}.items():
        monkeypatch.setattr(recurrent_lm, name, value)
    caught = []
    train = recurrent_lm.train
    monkeypatch.setattr(recurrent_lm, "train", lambda *a: caught.append(train(*a)) or caught[-1])
    texts = _texts()
    rows = [(i, t, i, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], 0, "y", 2), (None, texts[1], 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, rare string, row long").repartition(2)
    held = id_fold(F.col("doc_id")) == 1
    tokens = {i: [*WORD.findall(_lower(t or "")), END] for i, t in [*enumerate(texts), (None, texts[1])]}
    counts = collections.Counter(w for i, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in tokens[i])
    results = []
    for lookup in (recurrent_lm.LOOKUP, 3):
        got = recurrent_lm.score_documents(docs, held, lookup).collect()
        plain = Plain(counts, caught[-1], 5, 6, 4)
        assert len(plain.slot) > 12 and sum(map(len, plain.others.values())) > 50
        assert len(got) == len(rows)
        for r in got:
            want = plain.score(tokens[r.doc_id])
            assert abs(r.score - want) < 1e-4 * max(1, abs(want)), r
            assert r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id])
        results.append({r.doc_id: r.base_score for r in got})
    assert all(abs(results[0][k] - results[1][k]) < 1e-6 * max(1, abs(results[0][k])) for k in results[0])
    # all words, and one that is unseen in each class of several, have a probability of one together
    for h in (np.zeros(16), np.linspace(-1, 1, 16)):
        p = plain.classes(h)
        whole = sum(p[plain.of(w)] * plain.within(h, w) for w in {*counts, END})
        for k in range(len(plain.frequent), 12):
            logits = h @ plain.net["inner"][k] + plain.net["inner_bias"][k]
            e = np.exp(logits - logits.max())
            whole += p[k] * e[-1] / e.sum() * 0.5 / (sum(counts[w] for w in plain.others[k]) + 0.5 * (len(plain.others[k]) + 1))
        assert abs(whole - 1) < 1e-9


def test_the_state_tells_words_within_a_class():
    # after 0 comes slot 0 of class 2, after 1 its slot 1: counts know them as equally frequent
    rng = np.random.default_rng(1)
    first = rng.integers(0, 2, 4000)
    classes, slots = np.full(8000, 2), np.full(8000, -1)
    classes[::2], slots[1::2] = first, first
    edges = np.arange(0, 8001, 80)
    net = gated_network.new_network(3, 8, np.array([0.25, 0.25, 0.5]), inner_bias=np.log(np.array([[1, 1], [1, 1], [1, 1]])))
    before = gated_network.log_probabilities(net, classes, edges, 0, slots=slots)[1::2].mean()
    trainer = gated_network.Trainer(net, 0)
    for _ in range(12):
        trainer.learn(classes, edges, most_lanes=32, slots=slots)
    after = gated_network.log_probabilities(trainer.net, classes, edges, 0, slots=slots)[1::2].mean()
    assert before < -0.6 and after > -0.15


def test_gradient_of_the_slots():
    rng = np.random.default_rng(0)
    bias = np.log(rng.random((4, 3)) + 0.5)
    bias[3, 1] = -1e4
    net = {k: v.astype(np.float64) for k, v in gated_network.new_network(4, 3, np.full(4, 0.25), inner_bias=bias).items()}
    net["inner"] = rng.normal(0, 0.5, net["inner"].shape)
    classes, offsets = rng.integers(0, 4, 14), np.array([0, 8, 14])
    slots = np.where(classes == 0, -1, np.where(classes == 3, 2, rng.integers(0, 3, 14)))
    trainer = gated_network.Trainer(net, 0, length=14)
    caught = {}
    trainer._update = lambda grad: caught.update(grad)
    trainer.learn(classes, offsets, most_lanes=2, slots=slots)
    for k, at in (("inner", (1, 0, 0)), ("inner", (2, 1, 2)), ("inner", (3, 2, 0)), ("inner_bias", (1, 1)), ("recur", (1, 4)), ("embed", (2, 4)), ("output", (1, 2))):
        losses = []
        for step in (1e-4, -1e-4):
            moved = {n: v.copy() for n, v in net.items()}
            moved[k][at] += step
            losses.append(-gated_network.log_probabilities(moved, classes, offsets, 0, slots=slots).astype(np.float64).mean())
        assert abs((losses[0] - losses[1]) / 2e-4 - caught[k][at]) < 3e-3, (k, at)
