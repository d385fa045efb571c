"""Size-aware heavy-light Jaccard self-join of documents as sets of word n-grams, and its components.

Two sets link when ``100 * intersection >= percent * union``. Sets of equal content are one set from the start. Texts are read
and hashed once: the sets are written, and everything later reads them.

* Light sets list fixed-size subsets of themselves. Two sets of a and b n-grams link exactly when they share at least
  ``needed(a, b)`` of them, that is, when they have a subset of that size in common. A light set lists its
  subsets of every size that a partner can call for, so light links follow from equal keys.
* Heavy sets scan inverted lists. In one order of all n-grams, sets that link share an n-gram within the first
  ``prefix_length`` of each, which make the lists. A set first lists a quarter more in the order of hashes, and the lengths of these
  lists tell which n-grams are frequent. Sets with enough n-grams that aren't go by the order that has frequent ones last, so what
  many texts share brings them into no common list; pairs with one of the other sets go by the order of hashes. Size and a 512-bit
  parity sketch rule out most pairs within the join, a wider sketch most of the others.
* The boundary is the largest size up to which listing subsets costs no more than scanning lists, whose length is measured on this input.
* Every pair that is left is checked on the whole sets.

For components, groups of near copies are drawn together before lists are joined with themselves: a few leaders of a list and size band
(the set that stands in the longest lists, and the first ones by hash) are proposed to the others of the list, and the partners that most of a set's lists propose to it are checked. Sets that are
connected by then aren't paired again: lists of a single component go, and pairs within one are not made. That
leaves the components as they are, and the links between different components. Sets of which nearly all is frequent meet others with their
leader by this leader, once, and not in every list that they share. All other sets meet in the lists of what isn't frequent alone, so texts that share a
footer bring no pairs together.

Counts, orders and lists are distributed: nothing of them goes to the driver, and nothing is capped.

Defined results: a null or empty text, or one without words, is an empty set, linked with nothing; fewer than n
words make one n-gram; every input row gives one row; rows that share a doc_id, or have a null one, keep
their own sets; a component is named by the smallest doc_id in it that isn't null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import partial, reduce
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.components import connected_components
from accordant.llm.shared import ROW_GROUP, Tables, find_words, mix, text_chunks, text_keys, word_windows, written

#: An n-gram is frequent from more list entries than this on.
RARE = 64
#: Percentage of a set's list entries that it has to share with a partner to be checked early.
SHARED_FROM = 20
#: Entries of a list from which on partners are proposed in it, and how many.
CROWD = 4
LEADERS = 3
#: Names of sets that a task remembers to have listed, and entries that it sends on at once.
REMEMBERED = 200_000
LISTED_AT_ONCE = 150_000
SKETCH_LONGS = 8
SKETCHES = tuple(f"b{i}" for i in range(SKETCH_LONGS))
#: Sets larger than this have a wide sketch too, for the small one is too full to tell them apart.
WIDE_FROM = 800
WIDE_LONGS = 64


def needed(a: int, b: int, percent: int) -> int:
    """Smallest intersection with which sets of a and b elements link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def listed_length(size: int, percent: int) -> int:
    """How many n-grams a set lists in the order of hashes, to find enough that aren't frequent."""
    length = prefix_length(size, percent)
    return min(size, length + length // 4 + 1)


def subset_sizes(size: int, largest: int, percent: int) -> list[int]:
    """Sizes of subsets that a set of this size shares with a partner of at most ``largest`` elements."""
    partners = range(-(-percent * size // 100), min(largest, 100 * size // percent) + 1)
    return sorted({c for b in partners if b and (c := needed(size, b, percent)) <= min(size, b)})


def light_boundary(list_length: float, percent: int, largest: int) -> int:
    """Largest size up to which the subsets of a set are no more than the entries of the lists that it would scan."""
    best = 0
    for size in range(1, largest + 1):
        # partners beyond a boundary at this size are found by lists
        if sum(comb(size, c) for c in subset_sizes(size, size, percent)) > max(1.0, prefix_length(size, percent) * list_length):
            break
        best = size
    return best


def text_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For every text the sorted hashes of its distinct n-grams."""
    words = find_words(data, offsets)
    first, code = word_windows(words, n)
    doc = words.doc[first]
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    word_edges = np.searchsorted(words.doc, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        own = code[edges[i] : edges[i + 1]]
        if not len(own) and word_edges[i + 1] > word_edges[i]:
            value = np.full(1, word_edges[i + 1] - word_edges[i], np.uint64)
            for w in words.code[word_edges[i] : word_edges[i + 1]]:
                value = mix(value * np.uint64(0x9FB21C651E98DF25) + w)
            own = value
        out.append(np.unique(own))
    return out


def _set_key(own: np.ndarray) -> bytes:
    """128 bits that name the content of a set."""
    if not len(own):
        return b""
    other = mix(own ^ np.uint64(0xA0761D6478BD642F))
    return np.array([mix(own.copy()).sum(), other.sum() ^ np.uint64(len(own))], dtype=np.uint64).tobytes()


def _name(key: bytes) -> int | None:
    """64 of the bits, by which the lists know a set; sets that share a name are told apart by the check of whole sets."""
    return int.from_bytes(key[:8], "little", signed=True) if key else None


def _sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """Bit i: whether the number of elements that hash to i is odd."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    """The sets of a binary column, without copies."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _write_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in text_chunks(_column(batch, "text")):
            sets = text_sets(data, offsets, n)
            sketches = np.array([_sketch(s, 64 * SKETCH_LONGS).view(np.int64) for s in sets]).reshape(len(sets), SKETCH_LONGS)
            keys = [_set_key(s) for s in sets]
            columns = {c: _column(batch, c).slice(at, to - at) for c in ("doc_id", "k1", "k2")}
            columns |= {"set_key": pa.array(keys, pa.binary()), "name": pa.array([_name(k) for k in keys], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64())}
            columns |= {f"b{i}": pa.array(sketches[:, i]) for i in range(SKETCH_LONGS)}
            columns["wide"] = pa.array([_sketch(s, 64 * WIDE_LONGS).view(np.int64) if len(s) > WIDE_FROM else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns | {"own": pa.array([s.tobytes() for s in sets], pa.binary())})


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(name, set) of the sets that a task meets, equal ones once as far as it remembers them."""
    met: set[bytes] = set()
    for batch in batches:
        for key, name, own in zip(_column(batch, "set_key").to_pylist(), _column(batch, "name").to_pylist(), _sets_of(_column(batch, "own")), strict=True):
            if name is not None and key not in met:
                if len(met) >= REMEMBERED:
                    met.clear()
                met.add(key)
                yield name, own


def _subset_rows(own: np.ndarray, largest: int, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """(keys, size) of the subsets that a light set lists: the sum over all elements less that over the left-out ones."""
    codes = mix(own ^ np.uint64(0xE7037ED1A0B428DB))
    total = codes.sum(dtype=np.uint64)
    for size in subset_sizes(len(own), largest, percent):
        out = np.array(list(itertools.combinations(range(len(own)), len(own) - size)), dtype=np.int64).reshape(comb(len(own), size), len(own) - size)
        yield mix((total - codes[out].sum(axis=1, dtype=np.uint64)) + np.uint64(size * 0x8EBC6AF09C88C6E3 % 2**64)), size


def _lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """What sets list: (key, name of the set, place of the key in the set)."""
    keys, names, counts, waiting = [], [], [], 0

    def tell() -> pa.RecordBatch:
        places = np.arange(waiting) - np.repeat(np.cumsum(counts) - counts, counts)
        return pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "name": pa.array(np.repeat(np.array(names, np.int64), counts)), "at": pa.array(places.astype(np.int32))})

    for name, own in _new_sets(batches):
        keys.append(own[: listed_length(len(own), percent)])
        names.append(name)
        counts.append(len(keys[-1]))
        waiting += counts[-1]
        if waiting >= LISTED_AT_ONCE:
            yield tell()
            keys, names, counts, waiting = [], [], [], 0
    if keys:
        yield tell()


def _subsets(batches: Iterator[pa.RecordBatch], percent: int, light: int) -> Iterator[pa.RecordBatch]:
    """What light sets list: (key, size of the subset, id of the set, size of the set)."""
    for batch in batches:
        for id_, own in zip(_column(batch, "id").to_pylist(), _sets_of(_column(batch, "own")), strict=True):
            for keys, size in _subset_rows(own, light, percent):
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "subset": pa.array([size] * len(keys), pa.int64()), "id": pa.array([id_] * len(keys), pa.int64()), "n": pa.array([len(own)] * len(keys), pa.int64())})


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(_sets_of(_column(batch, "left_set")), _sets_of(_column(batch, "right_set")), strict=True):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _band(n: Column, percent: int) -> Column:
    """Size bands: sets that link are in the same one or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (log(100 / percent) * (1 + 1e-9))) if percent < 100 else n


def _may_link(size: Column, percent: int, suffixes: tuple[str, str] = ("_x", "_y")) -> Column:
    """Whether the sketches of two sets, of ``size`` n-grams together, don't rule out that they link."""
    x, y = suffixes
    most = size - 2 * F.ceil(percent * size / (100 + percent))
    small: Column = sum((F.bit_count(F.col(f"b{i}{x}").bitwiseXOR(F.col(f"b{i}{y}"))) for i in range(1, SKETCH_LONGS)), F.bit_count(F.col(f"b0{x}").bitwiseXOR(F.col(f"b0{y}"))))
    wide = F.aggregate(F.zip_with(f"wide{x}", f"wide{y}", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    return (small <= most) & F.coalesce(wide <= most, F.lit(True))


def _checked(tables: Tables, members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs(a, b) that link, by their whole sets."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    whole = tables.write(members.select(F.col("row").alias("id"), "own").join(wanted, "id", "left_semi"), "whole-sets", ROW_GROUP)
    both = pairs.select("a", "b").join(whole.select(F.col("id").alias("a"), F.col("own").alias("left_set")), "a").join(whole.select(F.col("id").alias("b"), F.col("own").alias("right_set")), "b")
    links = tables.write(both.mapInArrow(partial(_linked, percent=percent), "a long, b long"), "links")
    tables.drop("whole-sets")
    return links


def _proposed(tables: Tables, entries: DataFrame, percent: int) -> DataFrame:
    """(id, n, shared, kind, leader, leader_n): sets and the partners of their band that lead many of their lists.

    Of a group of near copies, the set that stands in the longest lists is the one that most of it looks like.
    """
    banded = entries.where(F.col("c") >= CROWD).select("key", _band(F.col("n"), percent).alias("band"), "id", "n", "c")
    standing = banded.groupBy("id").agg(F.sum("c").alias("standing"), F.count("*").alias("lists"))
    banded = tables.write(banded.drop("c").join(standing, "id"), "list-standings")
    by = [F.col("standing"), *[F.xxhash64(F.lit(k), "id") for k in range(1, LEADERS)]]
    leaders = banded.groupBy("key", "band").agg(F.array(*[F.struct(F.lit(k).alias("kind"), F.max_by(F.struct("id", "n"), F.struct(b, "id")).alias("set")) for k, b in enumerate(by)]).alias("leaders"))
    met = banded.join(leaders, ["key", "band"]).select("id", "n", "lists", F.explode("leaders").alias("leader")).where("id <> leader.set.id")
    met = met.groupBy("id", "n", "lists", "leader").agg(F.count("*").alias("shared"))
    # most of the lists of a near copy have the leader, unless it differs as much as it may; no more than 100 / SHARED_FROM partners of a kind
    likely = met.where(100 * F.col("shared") >= SHARED_FROM * F.col("lists"))
    proposals = tables.write(likely.select("id", "n", "shared", F.col("leader.kind").alias("kind"), F.col("leader.set.id").alias("leader"), F.col("leader.set.n").alias("leader_n")), "proposals")
    tables.drop("list-standings")
    return proposals


def _near(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs(a, b, size) whose sketches don't rule out a link."""

    def side(node: str, suffix: str) -> DataFrame:
        return members.select(F.col("row").alias(node), *[F.col(c).alias(c + suffix) for c in (*SKETCHES, "wide")])

    both = pairs.distinct().join(side("a", "_x"), "a").join(side("b", "_y"), "b")
    return both.where(_may_link(F.col("size"), percent)).select("a", "b")


def ngram_links(documents: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(doc_id, n, rep) has every document with the name of its set, the smallest doc_id that has it;
    links(a, b) has every two names of sets that link, once, and nothing else. In a group of near copies that is every pair.
    Names tell sets apart if doc_ids are unique and not null."""
    members, named, links = _members_and_edges(Tables(documents.sparkSession), documents, n, percent, every=True)
    reps = named.select("id", "rep")
    named_links = links.join(reps.toDF("a", "x"), "a").join(reps.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return members.select("doc_id", "n", "set_key").join(named.select("set_key", "rep"), "set_key", "left").drop("set_key"), named_links


def _members_and_edges(tables: Tables, documents: DataFrame, n: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, named, edges). members(row, doc_id, k1, k2, n, set_key, ...): a row for each document; named(set_key, name, n, id, rep): the different sets, known
    by the number of their first row; edges(a, b) of set ids: with every, the links; without, they connect the same sets, but leave out links within early
    components and have others of these in their place."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_keys("text"))
    schema = "doc_id long, k1 long, k2 long, set_key binary, name long, n long, " + ", ".join(f"{b} long" for b in SKETCHES) + ", wide array<long>, own binary"
    members = tables.write(docs.mapInArrow(partial(_write_sets, n=n), schema).withColumn("row", F.monotonically_increasing_id()), "sets", ROW_GROUP)
    sets = members.where("n > 0")
    named = tables.write(sets.groupBy("set_key", "name", "n").agg(F.min("row").alias("id"), F.min("doc_id").alias("rep")), "different-sets")

    entries = _entries(tables, sets, named, percent)
    lengths = entries.where("rare").groupBy("key").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
    light = light_boundary((lengths[0] or 1.0) / (lengths[1] or 1.0), percent, named.agg(F.max("n")).first()[0] or 0)

    early = places = None
    if not every:
        proposals = _proposed(tables, entries, percent)
        proposed = proposals.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"), (F.col("n") + F.col("leader_n")).alias("size"))
        near = tables.write(_near(members, proposed, percent), "near-pairs")
        early = tables.write(connected_components(_checked(tables, members, near, percent)), "early-components")
        leaders = proposals.where("kind = 0").groupBy("id").agg(F.max_by("leader", F.struct("shared", "leader")).alias("leader"))
        places = tables.write(early.withColumnRenamed("node", "id").join(leaders, "id", "full"), "places")
        tables.drop("proposals", "near-pairs", "links")
    entries = tables.write(_placed(entries.drop("c"), places), "placed-entries")
    tables.drop("list-entries")
    # each kind of meeting by itself, so that a plan stays small
    found = [
        tables.write(_by_subsets(_placed(_subset_entries(tables, members, named, light, percent), places), percent).distinct(), "pairs"),
        tables.write(_by_rare_lists(entries, members, light, percent), "pairs"),
        tables.write(_by_hard_lists(entries, members, light, percent).distinct(), "pairs"),
    ]
    if not every:
        found.append(tables.write(_by_leaders(entries, members, light, percent), "pairs"))
    tables.drop("placed-entries", "subsets")
    links = _checked(tables, members, reduce(DataFrame.union, found).distinct(), percent)
    tables.drop("pairs", "places")
    if early is not None:
        links = links.union(early.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    return members, named, links


def _entries(tables: Tables, sets: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, c, hard, rare, early) of list entries that several sets have. c: entries of the list; hard: too few of what the set has listed isn't frequent;
    rare: among the first of the set in the order that has frequent n-grams last, unless it is hard; early: among the first in the order of hashes."""
    keys = sets.select("set_key", "name", "own").mapInArrow(partial(_lists, percent=percent), "key long, name long, at int")
    # one shuffle serves all that follows; its partitions hold twice as many hash tables as others
    keys = keys.repartition(2 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    several = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("name").alias("lo"), F.max("name").alias("hi"), F.max("at").alias("last"))
    several = several.where("lo < hi and last >= 0").select("key", "c")  # reads all columns, so that both sides of the join share the shuffle
    lists = tables.write(keys.join(several.hint("shuffle_hash"), "key").distinct(), "lists")
    lists = lists.join(named.select("name", "id", "n"), "name")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    known = F.least("n", first + F.floor(first / 4) + 1)
    of_set = Window.partitionBy("name", "id")  # the join has dealt them by name
    frequent = F.when(F.col("c") > RARE, 1).otherwise(0)
    lists = lists.withColumns({"before": F.sum(frequent).over(of_set.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "all": F.sum(frequent).over(of_set)})
    hard = known - F.col("all") < first
    rare = ~hard & (F.col("c") <= RARE) & (F.col("at") - F.col("before") < first)
    early = F.col("at") < first
    entries = tables.write(lists.select("key", "id", "n", "c", hard.alias("hard"), rare.alias("rare"), early.alias("early")).where("rare or early"), "list-entries")
    tables.drop("lists")
    return entries


def _placed(entries: DataFrame, places: DataFrame | None) -> DataFrame:
    """The entries with early component and leader of their sets; sets without a leader have one that no other set has."""
    if places is None:
        return entries.withColumns({"component": F.col("id"), "leader": -1 - F.col("id")})
    return entries.join(places, "id", "left").withColumns({"component": F.coalesce("component", "id"), "leader": F.coalesce("leader", -1 - F.col("id"))})


def _mixed(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of lists that several components meet in."""
    return entries.join(entries.groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(*keys), keys)


def _side(entries: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return entries.select(*keys, *[F.col(c).alias(c + suffix) for c in entries.columns if c not in keys])


def _sizes_fit(light: int, percent: int) -> Column:
    """Whether sets of n_x and n_y n-grams, not both light, may link."""
    smaller, larger = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    return (larger > light) & (100 * smaller >= percent * larger)


def _near_pairs(met: DataFrame, light: int, percent: int) -> DataFrame:
    """(a, b) of the pairs of different components, not both light, that may link by size and sketches."""
    near = _sizes_fit(light, percent) & _may_link(F.col("n_x") + F.col("n_y"), percent)
    return met.where((F.col("component_x") != F.col("component_y")) & near).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def _by_rare_lists(entries: DataFrame, members: DataFrame, light: int, percent: int) -> DataFrame:
    """(a, b) of the pairs that meet in a list of at most ``RARE`` entries and may link; light sets meet each other elsewhere."""
    rare = _mixed(entries.where("rare").select("key", "id", "n", "component"), ["key"])
    met = _side(rare, ["key"], "_x").join(_side(rare, ["key"], "_y"), "key")
    met = met.where((F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")) & _sizes_fit(light, percent))
    return _near(members, met.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"), (F.col("n_x") + F.col("n_y")).alias("size")), percent)


def _by_hard_lists(entries: DataFrame, members: DataFrame, light: int, percent: int) -> DataFrame:
    """(a, b) of the pairs of a hard set and those of its lists that are in its size band or the next ones, have not the same leader, and may link."""
    sketches = members.select(F.col("row").alias("id"), *SKETCHES, "wide")
    early = entries.where("early").drop("rare", "early").withColumn("band", _band(F.col("n"), percent))
    hard = early.where("hard").drop("hard")
    beside = early.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1))).join(hard.select("key", "band").distinct(), ["key", "band"])
    met = _side(hard.join(sketches, "id"), ["key", "band"], "_x").join(_side(beside.join(sketches, "id"), ["key", "band"], "_y"), ["key", "band"])
    met = met.where((F.col("leader_x") != F.col("leader_y")) & _once())
    return _near_pairs(met, light, percent)


def _once() -> Column:
    """Of a hard set and another one the pair in this order, of two hard ones either."""
    return (F.col("id_x") < F.col("id_y")) | (~F.col("hard_y") & (F.col("id_x") != F.col("id_y")))


def _by_leaders(entries: DataFrame, members: DataFrame, light: int, percent: int) -> DataFrame:
    """(a, b) of the pairs of a hard set and another one that have the same leader and may link; those of other sets meet in rare lists."""
    sets = _mixed(entries.where("leader >= 0").select("leader", "id", "n", "component", "hard").distinct(), ["leader"])
    sets = sets.join(sets.where("hard").select("leader").distinct(), "leader", "left_semi").join(members.select(F.col("row").alias("id"), *SKETCHES, "wide"), "id")
    met = _side(sets.where("hard").drop("hard"), ["leader"], "_x").join(_side(sets, ["leader"], "_y"), "leader").where(_once())
    return _near_pairs(met, light, percent)


def _subset_entries(tables: Tables, members: DataFrame, named: DataFrame, light: int, percent: int) -> DataFrame:
    """(key, subset, id, n): the subsets that light sets list."""
    small = members.where(F.col("n").between(1, light)).select(F.col("row").alias("id"), "own").join(named.where(F.col("n") <= light).select("id"), "id", "left_semi")
    return tables.write(small.mapInArrow(partial(_subsets, percent=percent, light=light), "key long, subset long, id long, n long"), "subsets")


def _by_subsets(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the light pairs that have a subset of the size that they need in common."""
    entries = _mixed(entries.drop("leader"), ["key", "subset"])
    found = _side(entries, ["key", "subset"], "_x").join(_side(entries, ["key", "subset"], "_y"), ["key", "subset"])
    found = found.where((F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")))
    return found.where(F.col("subset") == F.expr(f"ceil({percent} * (n_x + n_y) / {100 + percent})")).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def _grouped(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, k1, k2, n, component, component_id) of every document: component is null for an empty set; component_id is the smallest doc_id of its component."""
    tables = Tables(documents.sparkSession)
    members, named, edges = _members_and_edges(tables, documents, n, percent, every=False)
    linked = tables.write(connected_components(edges), "components")
    names = linked.join(named.select(F.col("id").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    groups = named.select("set_key", "id", "rep").join(linked.join(names, "component"), F.col("id") == F.col("node"), "left")
    groups = groups.select("set_key", F.coalesce("component", "id").alias("component"), F.coalesce("least", "rep").alias("least"))
    rows = members.select("doc_id", "k1", "k2", "n", "set_key").join(groups, "set_key", "left").select("doc_id", "k1", "k2", "n", "component", F.coalesce("least", "doc_id").alias("component_id"))
    rows = written(rows, "ngram-groups")
    tables.drop()
    return rows


def ngram_components(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document. documents: doc_id, text."""
    return _grouped(documents, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays, with all its columns.

    Rows that share a doc_id but not a text are documents of their own; of rows that share both, one stays, as does the row with the text of the smallest hash
    where a component has several of its smallest doc_id. Rows without a doc_id can't be told apart and all stay, as do all different ones without words.
    """
    rows = _grouped(documents, n, percent).where("doc_id is not null").groupBy("component", "doc_id", "k1", "k2").agg(F.count("*").alias("times"))
    fields = ("doc_id", "k1", "k2", "times")
    of_groups = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(*fields)).alias("kept")).select("kept.*")
    chosen = written(of_groups.union(rows.where("component is null").select(*fields)), "kept")

    def those(keys: DataFrame) -> DataFrame:
        k1, k2 = text_keys("text")
        return documents.join(keys, (F.col("doc_id").cast("long") == keys["_ngram_id"]) & (k1 == keys["_ngram_k1"]) & (k2 == keys["_ngram_k2"]), "left_semi")

    named = chosen.toDF("_ngram_id", "_ngram_k1", "_ngram_k2", "_ngram_times")
    kept = those(named.where("_ngram_times = 1")).union(documents.where("doc_id is null"))
    repeated = named.where("_ngram_times > 1")
    return kept if repeated.isEmpty() else kept.union(those(repeated).dropDuplicates(["doc_id", "text"]))


def oracle_sql(n: int = 4, percent: int = 85) -> str:
    """The same in DuckDB, by joining all equal n-grams; for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) end) as g from d),
    c as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    l as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
    r(doc_id, component_id) as (select doc_id, doc_id from d union select l.b, r.component_id from r join l on l.a = r.doc_id)
    select r.doc_id, coalesce(any_value(c.n), 0) as n_shingles, min(component_id) as component_id from r left join c on c.doc_id = r.doc_id group by r.doc_id
    """
