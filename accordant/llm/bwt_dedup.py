"""Removal of byte strings that repeat anywhere, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another.

1. Equal texts are one text from here on; a text that several rows have repeats throughout.
2. Every possible start belongs to an anchor that the string's own bytes settle (``repeat_windows``). An anchor met once can't
   start a repeat. Only counts of anchors are shuffled.
3. Texts with repeated anchors are read once more. Their starts are dealt into bins with a common core; what is
   shuffled of a bin are hashes of the core and the at most 63 bytes on either side. Equal bins are counted
   together before the shuffle, so a group of copies weighs no more than one text.
4. Bins with equal cores but unequal flanks are joined into one text, each core a symbol of its own, and the intervals
   of its Burrows-Wheeler transform are expanded up to the length at which a core and its flanks make a whole string. A core with more than
   ``GROUP`` different flanks isn't gathered in a task: the half of each string's flanks next to the core joins it, which deals the group by
   longer cores; equal ones are counted together again, and the same step follows. After six steps no flank is left, so that a core has one.
5. The repeated starts, as intervals, are joined back to the texts, and the digests or the remaining text are made.

Passages can be counted in words instead of bytes: every word becomes its 64-bit hash, a symbol like a byte, and strings of so many symbols are looked for.

Defined results: a null text is an empty one; texts shorter than ``length`` stay whole; every input row gives one
row, repeated rows and ids included; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.bwt_intervals import repeated_windows
from accordant.llm.repeat_windows import BYTES, WORDS, Runs, Scale, deal_into_bins, find_runs, sums
from accordant.llm.shared import Tables, find_words, text_chunks, text_keys

LENGTH = 400
#: Words of a passage whose repeats are told beside those of strings.
PASSAGE_WORDS = 51
#: Different flanks of one core that a task gathers, at most.
GROUP = 20_000
#: Symbols whose suffixes are sorted at once, beyond which a task starts a new text at the next core.
SYMBOLS_AT_ONCE = 1_000_000
#: Bits of the filters that tell which texts a later step may need, for each such text; and all bits at most, 8 MB on the driver and in a task.
BITS_A_TEXT = 16
MOST_BITS = 1 << 26
REMEMBERED = 500_000


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _symbols(column: pa.Array, scale: Scale) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """text_chunks in symbols: the bytes, or a hash for each word and nothing for what is between words."""
    for at, to, data, offsets in text_chunks(column):
        if scale == WORDS:
            words = find_words(data, offsets, lower=False)
            data, offsets = words.code, np.searchsorted(words.doc, np.arange(len(offsets)))
        yield at, to, data, offsets


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of each, as a binary column."""
    size = end - start
    edges = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(edges[-1]) - np.repeat(edges[:-1] - start, size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((edges * data.itemsize).astype(np.int32)), pa.py_buffer(data[at])])


def _anchors(length: int, scale: Scale) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(code, k1, k2, c): how often the text k1, k2 has the anchor. A task tells of equal texts once, as far as it remembers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for batch in batches:
            keys = np.stack([_column(batch, k).to_numpy() for k in ("k1", "k2")], axis=1)
            new = np.zeros(len(keys), dtype=bool)
            for i, key in enumerate(map(tuple, keys.tolist())):
                if key not in told:
                    new[i] = True
                    told.add(key)
            if len(told) > REMEMBERED:
                told.clear()
            keys, texts = keys[new], _column(batch, "text").filter(pa.array(new))
            for at, _, data, offsets in _symbols(texts, scale):
                runs = find_runs(data, offsets, length, sums(data, 0), scale.gram(length))
                order = np.lexsort((runs.code, runs.doc))
                code, doc = runs.code[order], runs.doc[order]
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
                own = keys[at + doc[first]]
                yield pa.RecordBatch.from_pydict(
                    {"code": pa.array(code[first].view(np.int64)), "k1": pa.array(own[:, 0]), "k2": pa.array(own[:, 1]), "c": pa.array(np.diff(np.append(first, len(code))))}
                )

    return run


def _needed_texts(keys: Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(k1, k2, text) of the texts that pass the filter, equal ones once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for batch in batches:
            keep = keys.may_hold(_column(batch, "k1").to_numpy())
            for i in np.flatnonzero(keep):
                key = (_column(batch, "k1")[i].as_py(), _column(batch, "k2")[i].as_py())
                keep[i] = key not in told
                if len(told) < REMEMBERED:
                    told.add(key)
            yield batch.select(["k1", "k2", "text"]).filter(pa.array(keep))

    return run


def _contexts(length: int, scale: Scale) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bins of the runs whose anchors repeat: core, flanks, text, first start and number of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, codes = _column(batch, "k1").to_numpy(), _column(batch, "k2").to_numpy(), _column(batch, "codes")
            for at, _, data, offsets in _symbols(_column(batch, "text"), scale):
                total = sums(data, 0)
                runs = find_runs(data, offsets, length, total, scale.gram(length))
                wanted = np.zeros(len(runs.doc), dtype=bool)
                edges = np.searchsorted(runs.doc, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    own = codes[at + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    wanted[edges[i] : edges[i + 1]] = np.isin(runs.code[edges[i] : edges[i + 1]], own)
                runs = Runs(*(v[wanted] for v in runs))
                bins = deal_into_bins(runs, length, (total, sums(data, 1)), scale.bin)
                doc = runs.doc[bins.run]
                yield pa.RecordBatch.from_pydict(
                    {
                        "high": pa.array(bins.high.view(np.int64)),
                        "low": pa.array(bins.low.view(np.int64)),
                        "left": _slices(data, bins.first, bins.core),
                        "right": _slices(data, bins.core_end, bins.stop + length - 1),
                        "k1": pa.array(k1[at + doc]),
                        "k2": pa.array(k2[at + doc]),
                        "first": pa.array(bins.first - offsets[doc]),
                        "n": pa.array(bins.stop - bins.first),
                    }
                )

    return run


_SPANS = "id1 long, id2 long, from_start long, to_start long"


def _span_rows(id1: np.ndarray, id2: np.ndarray, owner: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """Rows (id, first, last) of the runs of consecutive start numbers of an owner."""
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1)]) if len(owner) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1 if len(first) else first
    return pa.RecordBatch.from_pydict(
        {"id1": pa.array(id1[owner[first]]), "id2": pa.array(id2[owner[first]]), "from_start": pa.array(number[first]), "to_start": pa.array(number[last])}
    )


def _expand(batches: Iterator[pa.RecordBatch], scale: Scale, depth: int) -> Iterator[pa.RecordBatch]:
    """Repeated starts of bins, whose rows come sorted by core: (id1, id2, first start, last start), counted within the bin. depth: symbols of a string, its core as one."""
    held: list[tuple] = []
    size = 0
    kind = np.uint8 if scale.unit == 1 else np.dtype("<u8")

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        flanks = [np.frombuffer(x, kind) for row in rows for x in row[2:4]]
        each = np.array([len(x) for x in flanks])
        flat = np.concatenate(flanks)
        symbols = flat.astype(np.int64) if scale.unit == 1 else np.unique(flat, return_inverse=True)[1].astype(np.int64)
        core = np.cumsum([1] + [a[:2] != b[:2] for a, b in zip(rows[1:], rows, strict=False)]) + (int(symbols.max()) + 1 if len(symbols) else 0)
        # left flank, core, right flank, end
        edges = np.cumsum(each + 1)
        text = np.zeros(edges[-1], dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[edges - 1] = False
        text[inside] = symbols + 1
        text[edges[::2] - 1] = core + 1
        base = edges[::2] - 1 - each[::2]
        n = np.array([r[4] for r in rows])
        owner = np.repeat(np.arange(len(rows)), n)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        weights = np.minimum(np.array([r[5] for r in rows]), 2)[owner]
        found = repeated_windows(text, base[owner] + number, weights, depth)
        return _span_rows(np.array([r[6] for r in rows]), np.array([r[7] for r in rows]), owner[found], number[found])

    for batch in batches:
        columns = [_column(batch, c).to_pylist() for c in ("high", "low", "left", "right", "n", "m", "id1", "id2")]
        for row in zip(*columns, strict=True):
            if size >= SYMBOLS_AT_ONCE and held[-1][:2] != row[:2]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += (len(row[2]) + len(row[3])) // scale.unit + 2
    if held:
        yield settle(held)


def _halved(bins: DataFrame, flank: int, unit: int) -> DataFrame:
    """Every bin as at most two with larger cores. flank: symbols of each string beside the core, on either side together.

    A string with half of them on the left has those next to the core added to it, any other one has as many on the right. Equal strings get
    equal cores, and half of the flank is left. from_start: number of the first start in the bin that was dealt.
    """
    half = (flank + 1) // 2
    left, right = F.octet_length("left") / unit, F.octet_length("right") / unit
    cut = bins.withColumns({"l": left.cast("long"), "r": right.cast("long")}).withColumn("k", F.least("n", F.greatest(F.col("l") - half + 1, F.lit(0))))

    def part(condition: str, side: int, left: str, inner: str, right: str, n: str, base: str) -> DataFrame:
        key = [F.col("high"), F.col("low"), F.lit(side), F.expr(inner)]
        return cut.where(condition).select(
            F.xxhash64(*key).alias("high"), F.xxhash64(F.lit(47), *key).alias("low"), F.expr(left).alias("left"), F.expr(right).alias("right"),
            F.expr(n).alias("n"), "m", "id1", "id2", F.expr(base).alias("from_start"),
        )

    symbols = lambda name, first, count: f"substring({name}, cast(({first}) * {unit} + 1 as int), cast(({count}) * {unit} as int))"
    by_left = part("k > 0", 0, symbols("left", "0", f"l - {half}"), symbols("left", f"l - {half}", str(half)), symbols("right", "0", "r - n + k"), "k", "from_start")
    by_right = part("k < n", 1, symbols("left", "k", "l - k"), symbols("right", "0", str(half)), symbols("right", str(half), f"r - {half}"), "n - k", "from_start + k")
    return by_left.union(by_right)


def _expanded(tables: Tables, bins: DataFrame, scale: Scale, flank: int, names: tuple[str, ...]) -> DataFrame:
    """Spans of starts of bins that occur elsewhere too. Cores with more than ``GROUP`` different flanks are made longer, again and again, until none has so many."""
    cores = bins.groupBy("high", "low").agg(F.count("*").alias("different"), F.min("m").alias("fewest"))
    cores = tables.write(cores.where("different > 1 and fewest = 1").select("high", "low", "different"), "mixed-cores")
    # bins are dealt by core before the join, so that one shuffle of them serves the join and the tasks that gather
    mixed = bins.repartition("high", "low").join(cores.where(F.col("different") <= GROUP).drop("different"), ["high", "low"], "left_semi")
    spans = mixed.sortWithinPartitions("high", "low").mapInArrow(partial(_expand, scale=scale, depth=flank + 1), _SPANS)
    everywhere = bins.where("m > 1").select("id1", "id2", F.lit(0).cast("long").alias("from_start"), (F.col("n") - 1).alias("to_start"))
    spans = spans.join(everywhere.select("id1", "id2"), ["id1", "id2"], "left_anti").union(everywhere)
    large = cores.where(F.col("different") > GROUP)
    if large.isEmpty():
        return spans
    most = bins.join(large.drop("different"), ["high", "low"], "left_semi").withColumn("from_start", F.lit(0).cast("long"))
    parts = _halved(most, flank, scale.unit).withColumnsRenamed({"id1": "own1", "id2": "own2"})
    parts = tables.write(parts.withColumns({"id1": F.xxhash64(*names), "id2": F.xxhash64(F.lit(43), *names)}), "longer-cores")
    again = tables.write(parts.groupBy(*names, "id1", "id2", "n").agg(F.sum("m").alias("m")), "different-longer-cores")
    found = _expanded(tables, again, scale, flank - (flank + 1) // 2, names).withColumnRenamed("from_start", "first")
    placed = parts.select("own1", "own2", "id1", "id2", "from_start").join(found, ["id1", "id2"])
    return spans.union(placed.select(F.col("own1").alias("id1"), F.col("own2").alias("id2"), (F.col("from_start") + F.col("first")).alias("from_start"), (F.col("from_start") + F.col("to_start")).alias("to_start")))


class Filter:
    """Bits for the first halves of some keys: says no only of keys that are none of them."""

    def __init__(self, keys: DataFrame):
        count = keys.count()
        self.size = min(MOST_BITS, max(1 << 16, 1 << int(BITS_A_TEXT * count).bit_length()))
        at, bits = F.expr(f"pmod(k1, {self.size}) div 32"), F.expr(f"bit_or(shiftleft(1L, cast(pmod(k1, {self.size}) % 32 as int)))")
        words = keys.groupBy(at.alias("at")).agg(bits.alias("bits")).toArrow()  # a row for 32 bits
        self.bits = np.zeros(self.size // 32, dtype=np.uint32)
        self.bits[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)

    def may_hold(self, k1: np.ndarray) -> np.ndarray:
        place = k1.view(np.uint64) & np.uint64(self.size - 1)
        return (self.bits[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def repeated_spans(documents: DataFrame, length: int = LENGTH, words: bool = False, tables: Tables | None = None) -> DataFrame:
    """verdicts(k1, k2, whole, spans): texts with repeats; spans are intervals [from, to) of bytes that go, unless all do. k1 and k2 name the text.
    With words, length and spans are in words, and whole tells of a text that several rows have, be it long enough or not.
    tables: what writes the result, which stays until it is dropped there; what steps write goes with the step that reads it last."""
    tables, steps = tables or Tables(documents.sparkSession), Tables(documents.sparkSession)
    scale = WORDS if words else BYTES
    source = documents.select(*text_keys("text"), F.coalesce("text", F.lit("")).alias("text"))
    long_enough = source.where(F.octet_length("text") >= (2 * length - 1 if words else length))
    whole = long_enough.groupBy("k1", "k2").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")

    anchors = long_enough.mapInArrow(_anchors(length, scale), "code long, k1 long, k2 long, c long")
    anchors = anchors.repartition("code").groupBy("code", "k1", "k2").agg(F.max("c").alias("c"))  # one shuffle serves both that follow
    several = anchors.groupBy("code").agg(F.sum("c").alias("times")).where("times > 1")
    needed = steps.write(anchors.join(several, "code").groupBy("k1", "k2").agg(F.collect_list("code").alias("codes")), "anchors")

    found = source.mapInArrow(_needed_texts(Filter(needed)), "k1 long, k2 long, text string")
    found = found.join(needed, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    contexts = found.mapInArrow(_contexts(length, scale), "high long, low long, left binary, right binary, k1 long, k2 long, first long, n long")
    names = ("high", "low", "left", "right")
    contexts = contexts.withColumns({"id1": F.xxhash64(*names), "id2": F.xxhash64(F.lit(43), *names)})
    contexts = steps.write(contexts, "bins")
    steps.drop("anchors")

    bins = contexts.groupBy(*names, "id1", "id2", "n").agg(F.count("*").alias("m"))
    bins = steps.write(bins, "different-bins")
    spans = _expanded(steps, bins, scale, scale.bin - 1, names)
    placed = contexts.select("id1", "id2", "k1", "k2", "first").join(spans, ["id1", "id2"])
    placed = placed.select("k1", "k2", F.struct((F.col("first") + F.col("from_start")).alias("from"), (F.col("first") + F.col("to_start") + length).alias("to")).alias("span"))
    starts = placed.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))  # no more than the text has bytes
    verdicts = starts.join(whole.withColumn("whole", F.lit(True)), ["k1", "k2"], "full").select("k1", "k2", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    out = tables.write(verdicts, "repeats")
    steps.drop()
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, as maximal ones."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def removed_spans(text: bytes, whole: bool | None, spans: list[dict] | None) -> list[tuple[int, int]]:
    if whole:
        return [(0, len(text))]
    return merge_spans([(s["from"], s["to"]) for s in spans or ()])


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for low, high in spans:
        out.append(text[at:low])
        at = high
    return b"".join([*out, text[at:]])


def _lighten(keys: Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests of the texts that no verdict can be about, in their place; the others keep theirs for the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _column(batch, "text").to_pylist()
            open_ = keys.may_hold(_column(batch, "k1").to_numpy()).tolist()
            raw = [t.encode() for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": _column(batch, "doc_id"),
                    "k1": _column(batch, "k1"),
                    "k2": _column(batch, "k2"),
                    "n_bytes": pa.array([len(r) for r in raw], pa.int64()),
                    "digest": pa.array([None if o else hashlib.sha256(r).hexdigest() for r, o in zip(raw, open_, strict=True)], pa.string()),
                    "text": pa.array([t if o else None for t, o in zip(texts, open_, strict=True)], pa.string()),
                }
            )

    return run


def word_count(text: bytes) -> int:
    return len(find_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=False).doc)


def _digest(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, count, digests, passages, passage_words = [], [], [], [], []
        for text, digest, whole, spans, whole_too, more in zip(*[_column(batch, c).to_pylist() for c in ("text", "digest", "whole", "spans", "whole_too", "passages")], strict=True):
            found = merge_spans([(s["from"], s["to"]) for s in more or ()])
            if text is not None:
                raw = text.encode()
                cut = removed_spans(raw, whole, spans)
                removed.append(sum(b - a for a, b in cut))
                count.append(len(cut))
                digests.append(hashlib.sha256(kept_bytes(raw, cut)).hexdigest())
                if whole_too and (n := word_count(raw)) >= words:
                    found = [(0, n)]
            else:
                removed.append(0)
                count.append(0)
                digests.append(digest)
            passages.append(len(found))
            passage_words.append(sum(b - a for a, b in found))
        numbers = {k: pa.array(v, pa.int64()) for k, v in {"n_removed": removed, "n_spans": count, "n_passages": passages, "n_passage_words": passage_words}.items()}
        first = {c: _column(batch, c) for c in ("doc_id", "n_bytes")} | {c: numbers.pop(c) for c in ("n_removed", "n_spans")}
        yield pa.RecordBatch.from_pydict(first | {"kept_sha256": pa.array(digests, pa.string())} | numbers)


def removal_digests(documents: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, with words also n_passages and n_passage_words. documents: doc_id, text.

    Bytes go by strings of ``length`` bytes alone. n_passages counts the stretches of passages of ``words`` words that stand anywhere else too, however few
    bytes they have, and n_passage_words the words in them; they stay in the text.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *text_keys("text"))
    verdicts = _both_verdicts(docs, length, words)
    light = docs.mapInArrow(_lighten(Filter(verdicts)), "doc_id long, k1 long, k2 long, n_bytes long, digest string, text string")
    joined = light.join(verdicts, ["k1", "k2"], "left").select("doc_id", "n_bytes", "digest", "text", "whole", "spans", "whole_too", "passages")
    out = joined.mapInArrow(partial(_digest, words=words or 0), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long")
    return out.drop("n_passages", "n_passage_words") if words is None else out


def _both_verdicts(documents: DataFrame, length: int, words: int | None) -> DataFrame:
    """(k1, k2, whole, spans, whole_too, passages): what goes by bytes, and what by words."""
    tables = Tables(documents.sparkSession)
    by_bytes = repeated_spans(documents, length, tables=tables)
    if words is None:
        return by_bytes.withColumns({"whole_too": F.lit(False), "passages": F.lit(None).cast(by_bytes.schema["spans"].dataType)})
    by_words = repeated_spans(documents, words, words=True, tables=tables).withColumnsRenamed({"whole": "whole_too", "spans": "passages"})
    out = Tables(documents.sparkSession).write(by_bytes.join(by_words, ["k1", "k2"], "full"), "all-repeats")
    tables.drop()
    return out


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters that they cut at their ends."""
    out = []
    for low, high in spans:
        while low < high and text[low] & 0xC0 == 0x80:
            low += 1
        while high > low and high < len(text) and text[high] & 0xC0 == 0x80:
            high -= 1
        if low < high:
            out.append((low, high))
    return out


def passage_bytes(text: bytes, spans: list[dict] | None) -> list[tuple[int, int]]:
    """The bytes of spans of words, with the white space that follows them, and what stands before the first word."""
    if not spans:
        return []
    words = find_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=False)
    edges = np.append(words.start, len(text)).tolist()
    edges[0] = 0
    return [(edges[low], edges[high]) for low, high in merge_spans([(s["from"], s["to"]) for s in spans])]


def without_repeats(documents: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The documents with repeated strings cut from their texts; a character goes if all its bytes do, and a document with them, if
    nothing is left of a text that had something. Columns stay as they are; n_chars, if there is one, follows the text.

    words: passages of so many words that stand anywhere else too go as well, however few bytes they have.
    """
    k1, k2 = text_keys("text")
    verdicts = _both_verdicts(documents.select("text"), length, words)
    # the documents' columns as one, so that none has the name of another
    joined = documents.select(F.struct(*documents.columns).alias("row"), k1, k2).join(verdicts, ["k1", "k2"], "left").select("row", "whole", "spans", "whole_too", "passages")
    columns = documents.columns
    counts = "n_chars" in columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = dict(zip(columns, _column(batch, "row").flatten(), strict=True))
            out, keep = [], []
            for text, whole, spans, whole_too, passages in zip(rows["text"].to_pylist(), *[_column(batch, c).to_pylist() for c in ("whole", "spans", "whole_too", "passages")], strict=True):
                left = text or ""
                if text and (whole or spans or whole_too or passages):
                    raw = text.encode()
                    gone = whole_characters(raw, removed_spans(raw, whole or whole_too and word_count(raw) >= words, spans))
                    left = kept_bytes(raw, merge_spans(gone + passage_bytes(raw, passages))).decode()
                out.append(left)
                keep.append(bool(left) or not text)
            rows["text"] = pa.array(out, pa.string())
            if counts:
                rows["n_chars"] = pa.array([len(t or "") for t in out], pa.int64()).cast(rows["n_chars"].type)
            yield pa.RecordBatch.from_pydict(rows).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(cut, documents.schema)
