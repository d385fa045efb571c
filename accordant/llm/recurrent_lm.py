"""Document log-likelihoods by a gated recurrent language model with a class-factored output softmax.

The probability of a word is that of its class, given the whole document before it, times that of the word
in its class. Both are softmax outputs of a gated recurrent network (``gated_network``), trained by truncated
backpropagation in numpy, its state carried across windows. A class is one of the most frequent words alone, or
all words with the same last two bytes, or the rest. Within a class, each of its ``SLOTS - 1`` most frequent words has a slot with learned
weights, which start at log(count + 1/2); the last slot takes the class's other words, which share it by
their count + 1/2, with one more place for all words unseen in training.

What is learned covers every training document: the counts of all words (a distributed table), the classes (from those counts)
and the weights. For the weights the driver warms up on ``WARM_DOCUMENTS`` documents, then every trainer task takes
those weights through all documents of its share, and the trainers' weights are averaged, by token, in a
distributed sum. The average is what scores; the warm-up weights are only where the trainers start. A log line tells how many
trainers and tokens it is made of.

Counts of the ``LOOKUP`` most frequent words are looked up in memory while scoring; all other words of a document are joined
to the counts table, so the result is the same for any size of the lookup. Words of a class or slot of their own are always looked up.

Words are known by a 64-bit hash of their bytes. Defined results: a null or empty text is the end token alone; every
input row gives one row; other columns are ignored; without training documents all words are unseen.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.gated_network import Trainer, flatten, log_probabilities, new_network, restore
from accordant.llm.shared import LOWER, find_words, text_chunks, written

_log = logging.getLogger(__name__)

#: Classes of one frequent word; further classes of last two bytes; the last class takes the rest.
FREQUENT_CLASSES = 64
ENDING_CLASSES = 63
CLASSES = FREQUENT_CLASSES + ENDING_CLASSES + 1
WIDTH = 16
#: Slots of a class: its most frequent words, and one for the others.
SLOTS = 32
#: Words whose counts a task holds, at most (12 bytes each).
LOOKUP = 1 << 19
WARM_DOCUMENTS = 300
#: Tokens that a task trains or scores at once, and distinct words that it counts at once.
TOKENS_AT_ONCE = 3_000_000
#: Scan partitions to a trainer.
SHARES_PER_TRAINER = 4
#: Hash that stands for the end of a document.
END_CODE = 0x5EED0FE11D0C0DE5


@dataclass
class Vocabulary:
    """Counts in memory, and what the classes are."""

    total: int
    distinct: int
    codes: np.ndarray  # sorted
    counts: np.ndarray
    frequent: np.ndarray  # sorted codes of the one-word classes; class k has frequent[k]
    ending_class: np.ndarray  # class by the last two bytes
    class_total: np.ndarray
    class_words: np.ndarray
    named: np.ndarray  # sorted codes of the words with a slot
    named_slot: np.ndarray
    slot_bias: np.ndarray  # by class and slot
    tables: list[tuple[int, np.ndarray]] = field(default_factory=list)

    @property
    def end_class(self) -> int:
        return int(np.searchsorted(self.frequent, np.uint64(END_CODE)))

    def look_up(self, code: np.ndarray) -> np.ndarray:
        """Training count of each code, -1 if it isn't held."""
        if not self.tables:
            self._hash()
        out = np.full(len(code), -1, dtype=np.int64)
        left = np.arange(len(code))
        for shift, slots in self.tables:
            at = slots[(code[left] >> np.uint64(shift)).astype(np.int64) & (len(slots) - 1)]
            hit = (at >= 0) & (self.codes[at] == code[left])
            out[left[hit]] = self.counts[at[hit]]
            left = left[~hit & (at >= 0)]
        return out

    def _hash(self) -> None:
        """Tables of positions in ``codes``; what finds its slot taken goes to the next table."""
        bits = max(4, int(len(self.codes) * 2).bit_length())
        left = np.arange(len(self.codes))
        shift = 0
        while len(left) or not self.tables:
            slots = np.full(1 << bits, -1, dtype=np.int32)
            slot = (self.codes[left] >> np.uint64(shift)).astype(np.int64) & (len(slots) - 1)
            slots[slot[::-1]] = left[::-1]
            self.tables.append((shift, slots))
            left = left[slots[slot] != left]
            shift = (shift + 11) % (64 - bits)
            bits = max(4, int(len(left) * 2).bit_length())

    def classes(self, code: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return self.ending_class[ending].astype(np.int64)
        at = np.minimum(np.searchsorted(self.frequent, code), len(self.frequent) - 1)
        return np.where(self.frequent[at] == code, at, self.ending_class[ending])

    def slots(self, code: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Slot of each word in its class ``own``, -1 in a class of one word."""
        out = np.full(len(code), -1, dtype=np.int64)
        several = np.flatnonzero(own >= len(self.frequent))
        out[several] = self.slot_bias.shape[1] - 1
        if len(self.named):
            words = code[several]
            at = np.minimum(np.searchsorted(self.named, words), len(self.named) - 1)
            hit = self.named[at] == words
            out[several[hit]] = self.named_slot[at[hit]]
        return out

    def log_within(self, count: np.ndarray, own: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """log10 of the word's share of its slot, less log10(count + 1/2) where the count is unknown (-1)."""
        above = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0)
        last = self.slot_bias.shape[1] - 1
        return np.where(slot == last, above - self.slot_bias[own, last] / np.log(10), 0.0)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, last two bytes, offsets) of the tokens of every text, the end token included."""
    words = find_words(data, offsets)
    last = LOWER[data[words.end - 1]].astype(np.int64) if len(words.end) else np.zeros(0, np.int64)
    second = np.where(words.end - words.start > 1, LOWER[data[np.maximum(words.end - 2, 0)]] if len(data) else 0, 0).astype(np.int64)
    n = len(offsets) - 1
    counts = np.bincount(words.doc, minlength=n)
    edges = np.concatenate([[0], np.cumsum(counts + 1)])
    code = np.full(edges[-1], END_CODE, dtype=np.uint64)
    ending = np.zeros(edges[-1], dtype=np.int64)
    place = np.arange(len(words.doc)) + words.doc
    code[place], ending[place] = words.code, second * 256 + last
    return code, ending, edges


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at, to, data, offsets in text_chunks(batch.column(batch.schema.get_field_index("text"))):
            yield (batch, at, to, *_tokens(data, offsets))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merge() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, ending, count = (np.concatenate(x) for x in zip(*held, strict=True))
        values, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        return values, ending[first], np.bincount(inverse, count, len(values)).astype(np.int64)

    def row(words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"code": pa.array(words[0].view(np.int64)), "ending": pa.array(words[1]), "c": pa.array(words[2])})

    for _, _, _, code, ending, _ in _texts(batches):
        held.append((code, ending, np.ones(len(code), np.int64)))
        size += len(code)
        if size >= TOKENS_AT_ONCE:
            held = [merge()]
            size = len(held[0][0])
            if size >= TOKENS_AT_ONCE // 3:
                yield row(held[0])
                held, size = [], 0
    if held:
        yield row(merge())


def count_words(training: DataFrame) -> DataFrame:
    """(code, ending, c): every distinct training token, the last two bytes of a word, and how often it stands there."""
    rows = training.select("text").mapInArrow(_count, "code long, ending long, c long")
    return written(rows.groupBy("code").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")), "word-counts")


def build_vocabulary(counts: DataFrame, lookup: int = LOOKUP) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    most = counts.orderBy(F.desc("c"), "code").limit(FREQUENT_CLASSES).select("code", "c").collect()
    frequent = {int(r.code) % 2**64 for r in most} | {END_CODE}
    # words as frequent as the lookup can take: whole bins of counts, of which there are at most 16 times 64
    level = F.floor(F.log2("c") * 16)
    room, least = lookup, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r.level):
        room -= r.v
        if room < 0:
            break
        least = r.level
    held = counts.where(level >= least if least is not None else F.lit(False)).select("code", "c").toArrow()
    code, count = held.column("code").to_numpy().view(np.uint64), held.column("c").to_numpy()
    frequent = np.array(sorted(frequent), dtype=np.uint64)
    several = counts.where(~F.col("code").isin([int(x) for x in frequent.view(np.int64)]))
    by_ending = several.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # at most 65536 rows
    ranked = sorted(by_ending, key=lambda r: (-r.c, r.ending))
    room = CLASSES - 1 - len(frequent)
    ending_class = np.full(65536, CLASSES - 1, dtype=np.int64)
    for k, r in enumerate(ranked[:room]):
        ending_class[r.ending] = len(frequent) + k
    class_total, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_ending:
        class_total[ending_class[r.ending]] += r.c
        class_words[ending_class[r.ending]] += r.v
    times = {int(r.code) % 2**64: r.c for r in most}
    times.setdefault(END_CODE, 0)
    if END_CODE not in {int(r.code) % 2**64 for r in most}:
        times[END_CODE] = next((r.c for r in counts.where(F.col("code") == int(np.array(END_CODE, np.uint64).astype(np.int64))).collect()), 0)
    class_total[: len(frequent)] = [times[x] for x in frequent.tolist()]
    named, named_slot, slot_bias = _slots(several, ending_class, class_total, class_words)
    # words of a class or slot of their own are held whatever the room
    code = np.concatenate([code, frequent, named[0]])
    count = np.concatenate([count, np.array([times[x] for x in frequent.tolist()], np.int64), named[1]])
    code, first = np.unique(code, return_index=True)
    return Vocabulary(int(sums.n), int(sums.v), code, count[first], frequent, ending_class, class_total, class_words, named[0], named_slot, slot_bias)


def _slots(several: DataFrame, ending_class: np.ndarray, class_total: np.ndarray, class_words: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """((codes, counts), slots) of the most frequent words of each class of several words, sorted by code, and the logits of all slots by count."""
    own = [(F.lit(int(e)), F.lit(int(ending_class[e]))) for e in np.flatnonzero(ending_class < CLASSES - 1)]  # an ending for each class but the last
    class_of = F.lit(CLASSES - 1)
    if own:
        class_of = F.coalesce(F.create_map(*[x for pair in own for x in pair])[F.col("ending").cast("int")], class_of)
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("c"), "code"))  # a task sends no more than the first of each class
    rows = several.withColumn("class", class_of).withColumn("place", place).where(F.col("place") < SLOTS).select("class", "place", "code", "c").collect()
    bias = np.full((CLASSES, SLOTS), -1e4)
    total, words = class_total.copy(), class_words.copy()
    for r in rows:
        bias[r["class"], r.place - 1] = np.log(r.c + 0.5)
        total[r["class"]] -= r.c
        words[r["class"]] -= 1
    bias[:, -1] = np.log(total + 0.5 * (words + 1))
    code = np.array([r.code for r in rows], np.int64).view(np.uint64)
    order = np.argsort(code)
    return (code[order], np.array([r.c for r in rows], np.int64)[order]), np.array([r.place - 1 for r in rows], np.int64)[order], bias


def _train(vocabulary: Vocabulary, net: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(net, vocabulary.end_class, rate=0.004), 0
        held, slots, sizes = [], [], []

        def learn() -> None:
            trainer.learn(np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), slots=np.concatenate(slots))

        waiting = 0
        for _, _, _, code, ending, edges in _texts(batches):
            held.append(vocabulary.classes(code, ending))
            slots.append(vocabulary.slots(code, held[-1]))
            sizes.append(np.diff(edges))
            seen += len(code)
            waiting += len(code)
            if waiting >= TOKENS_AT_ONCE:
                learn()
                held, slots, sizes, waiting = [], [], [], 0
        if held:
            learn()
        if seen:
            flat = flatten(trainer.net).astype(np.float64) * seen
            yield pa.RecordBatch.from_pydict({"weights": pa.array([np.append(flat, seen)], pa.list_(pa.float64()))})

    return run


def train(training: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Weights learned from all training documents."""
    texts = training.select("doc_id", "text")
    frequency = (vocabulary.class_total + 0.5) / (vocabulary.class_total + 0.5).sum()
    net = new_network(CLASSES, WIDTH, frequency, inner_bias=vocabulary.slot_bias)
    sample = texts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCUMENTS).select("text").toPandas()["text"].tolist()
    if not sample:
        return net
    held, slots, sizes = [], [], []
    for _, _, data, offsets in text_chunks(pa.array(sample, pa.string())):
        code, ending, edges = _tokens(data, offsets)
        held.append(vocabulary.classes(code, ending))
        slots.append(vocabulary.slots(code, held[-1]))
        sizes.append(np.diff(edges))
    classes, edges = np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    warm = Trainer(net, vocabulary.end_class)
    for _ in range(3):
        warm.learn(classes, edges, most_lanes=32, slots=np.concatenate(slots))
    shares = training.select("text")
    shares = shares.coalesce(max(1, -(-shares.rdd.getNumPartitions() // SHARES_PER_TRAINER)))
    parts = shares.mapInArrow(_train(vocabulary, warm.net), "weights array<double>")
    summed = parts.select(F.posexplode("weights").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("trainers")).toPandas().sort_values("at")
    weights = summed["w"].to_numpy()  # there are some: every document has its end token at least
    _log.info("recurrent weights: the average of %d trainers over %d training tokens", summed["trainers"].iloc[0], weights[-1])
    return restore(weights[:-1] / weights[-1], net)


def _score(vocabulary: Vocabulary, net: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    floor = np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def tell() -> pa.RecordBatch:
            sizes = np.concatenate([h[4] for h in held])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            classes = np.concatenate([h[1] for h in held])
            doc = np.repeat(np.arange(len(sizes)), sizes)
            chance = log_probabilities(net, classes, edges, vocabulary.end_class, slots=np.concatenate([h[8] for h in held])).astype(np.float64) / np.log(10)
            total = lambda x: np.bincount(doc, x, len(sizes))
            within, base, known = (np.concatenate([h[k] for h in held]) for k in (2, 5, 6))
            rare = np.concatenate([h[3] for h in held])
            rare_doc = doc[np.concatenate([h[7] for h in held])]
            rare_edges = np.searchsorted(rare_doc, np.arange(len(sizes) + 1)).astype(np.int32)
            ids = pa.concat_arrays([h[0] for h in held])
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids,
                    "n_tokens": pa.array(sizes),
                    "n_known": pa.array(total(known).astype(np.int64)),
                    "base_score": pa.array(total(base)),
                    "score": pa.array(total(chance + within)),
                    "rare": pa.ListArray.from_arrays(pa.array(rare_edges), pa.array(rare.view(np.int64))),
                }
            )

        for batch, at, to, code, ending, edges in _texts(batches):
            count = vocabulary.look_up(code)
            own = vocabulary.classes(code, ending)
            slot = vocabulary.slots(code, own)
            unknown = count < 0
            base = np.where(unknown, 0.0, np.log10(np.maximum(count, 0) + 0.5)) - floor
            ids = batch.column(batch.schema.get_field_index("doc_id")).slice(at, to - at)
            held.append((ids, own, vocabulary.log_within(count, own, slot), code[unknown], np.diff(edges), base, (count > 0).astype(np.float64), unknown, slot))
            waiting += len(code)
            if waiting >= TOKENS_AT_ONCE:
                yield tell()
                held, waiting = [], 0
        if held:
            yield tell()

    return run


def score_documents(documents: DataFrame, held_out: Column, lookup: int = LOOKUP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``held_out`` tells, from the columns of documents (doc_id, text), the rows that nothing is learned from.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = count_words(training)
    vocabulary = build_vocabulary(counts, lookup)
    net = train(training, vocabulary)
    vocabulary.look_up(np.zeros(0, np.uint64))
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    scored = docs.select("doc_id", "text").mapInArrow(_score(vocabulary, net), schema)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("code")).groupBy("row", "code").agg(F.count("*").alias("m")).join(counts.select("code", "c"), "code", "left")
    c = F.coalesce("c", F.lit(0))
    added = rare.groupBy("row").agg(F.sum(F.col("m") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("also_known"))
    more = F.coalesce("more", F.lit(0.0))
    out = scored.drop("rare").join(added, "row", "left").withColumn("train_tokens", F.lit(vocabulary.total).cast("long"))
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("also_known", F.lit(0))).alias("n_known"),
        "train_tokens",
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
