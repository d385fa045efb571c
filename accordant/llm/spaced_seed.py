"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts become lower-case words (runs of letters and digits). A mask of ``SPAN`` positions keeps some words of a window and ignores
the others; windows of test items and of documents meet when the kept words are equal, so a substituted word does no harm where a mask
ignores it. Around every meeting the item is laid over the document, and equal words at equal places are
counted: a document holds an item if at least ``share`` of the item's words, and ``SPAN`` of them, are in place.

Documents' windows probe a hash table of the items' windows if those are no more than ``BROADCAST_ROWS`` (counted first), and are shuffled
by window hash otherwise. The meetings, one row for each item and shift in a document, are written; then the texts are read again, those with
meetings picked by a hash table of the same bound or else by a shuffle, and the items laid over them.

``contaminated`` judges an item as a whole, at one shift, as its SQL does. ``without_contaminated`` takes out more documents: the words in place in
stretches of ``SPAN`` words of which ``DENSE`` are equal also count at shifts up to ``NEAR`` from a meeting. A document holds an item, too, if
``PASSAGE`` of its words, less ``GAP`` for every word between them that is missing, are in place at shifts within ``NEAR``, however long the item is; if its
stretches at all shifts add up to ``share`` of the item; or if it quotes an item of ``QUOTE`` words or more, but fewer than ``SPAN``, whole. Items of fewer words are
common speech, such as "yes": they have to fill a line or a sentence, and an item of one word the whole text.

Defined results: for ``contaminated``, items with fewer than ``SPAN`` words have no window and are never found; null or empty texts and items hold nothing;
rows that share a doc_id count as one document, and rows with a null one too; items that share an id count as one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import written

#: Fixed masks: 1 keeps a word, 0 ignores it.
MASKS = ("1101011011", "1011100111")
SPAN = 10
SHARE = 0.5
BROADCAST_ROWS = 200_000
PASSAGE = 13
GAP = 2
DENSE = 7
NEAR = 4
QUOTE = 5
#: Where a sentence or a line ends.
_ENDS = r"\n|[.!?…。！？]+(?=\s|$)"


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _windows(df: DataFrame, key: str) -> DataFrame:
    """(key, place of the window's first word, seed), a row for each window and mask. Arrays of words don't go with the rows.

    The outer explode keeps Spark from testing the size of the array in a filter that would make it anew from the text.
    """
    many = len(MASKS)

    def seed(k: Column) -> Column:
        place = F.floor(k / many).cast("int")
        each = [F.xxhash64(F.lit(mask), *[F.get(F.col("hashes"), place + i) for i, c in enumerate(mask) if c == "1"]) for mask in MASKS]
        out = each[-1]
        for i, value in enumerate(each[:-1]):
            out = F.when(k % many == i, value).otherwise(out)
        return out

    seeds = F.transform(F.sequence(F.lit(0), (F.size("hashes") - SPAN + 1) * many - 1), seed)
    rows = df.withColumn("seeds", F.when(F.size("hashes") >= SPAN, seeds)).select(key, F.posexplode_outer("seeds").alias("k", "seed")).where("seed is not null")
    return rows.select(key, F.floor(F.col("k") / many).cast("int").alias("place"), "seed")


def _meetings(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift) of the windows that meet. items: item_id, hashes."""
    seeds = _windows(items, "item_id").withColumnRenamed("place", "item_place")
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    met = _windows(documents.select("doc_id", _hashed(F.col("text")).alias("hashes")), "doc_id").join(seeds, "seed")
    return written(met.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "meetings")


def _laid_over(documents: DataFrame, items: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, hashes, item_id, item_hashes, shift), a row for every meeting."""
    hits = met.withColumnRenamed("doc_id", "met_id").join(items.select("item_id", F.col("hashes").alias("item_hashes")), "item_id")
    if met.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    texts = documents.select("doc_id", _hashed(F.col("text")).alias("hashes"))
    return texts.join(hits, F.col("doc_id").eqNullSafe(F.col("met_id")))


def _held(both: DataFrame, share: float) -> DataFrame:
    shift = F.col("shift")
    from_doc, from_item = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    length = F.size("item_hashes") - from_item
    equal = F.zip_with(F.slice("hashes", from_doc + 1, length), F.slice("item_hashes", from_item + 1, length), lambda a, b: F.when(a == b, 1).otherwise(0))
    counted = both.select("doc_id", "item_id", F.size("item_hashes").alias("n_item"), F.aggregate(equal, F.lit(0), lambda x, y: x + y).alias("n_matched"))
    held = counted.where((F.col("n_matched") >= SPAN) & (F.col("n_matched") >= F.ceil(F.lit(share) * F.col("n_item"))))
    return held.groupBy("doc_id", "item_id").agg(F.max("n_item").cast("long").alias("n_item"), F.max("n_matched").cast("long").alias("n_matched"))


def contaminated(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_item, n_matched): items that a document holds, and how many of an item's words are in place.

    documents: doc_id, text; benchmark: item_id, text.
    """
    if benchmark.select("item_id").isEmpty():
        return documents.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_matched")).where("false")
    items = benchmark.select("item_id", _hashed(F.col("text")).alias("hashes"))
    return _held(_laid_over(documents, items, _meetings(documents, items)), share)


def _stretches(both: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, shift, at): places of the item in stretches of ``SPAN`` words of which ``DENSE`` are equal."""
    equal = F.transform("item_hashes", lambda w, j: F.when(F.get("hashes", j + F.col("shift")) == w, 1).otherwise(0))
    laid = both.select("doc_id", "item_id", F.size("item_hashes").alias("n_item"), "shift", equal.alias("equal"))

    def total(values: str, j: Column, steps: range) -> Column:
        return sum((F.coalesce(F.get(values, j + i), F.lit(0)) for i in steps), F.lit(0))

    laid = laid.withColumn("dense", F.transform("equal", lambda _, j: F.when(total("equal", j, range(SPAN)) >= DENSE, 1).otherwise(0)))
    laid = laid.where(F.array_contains("dense", 1))
    places = F.transform("equal", lambda e, j: F.when((e == 1) & (total("dense", j, range(1 - SPAN, 1)) > 0), j))
    return laid.select("doc_id", "item_id", "n_item", "shift", F.explode(places).alias("at")).where("at is not null")


def _quoted(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id) of the documents that quote whole an item of ``QUOTE`` to ``SPAN`` - 1 words."""
    short = items.where((F.size("hashes") >= QUOTE) & (F.size("hashes") < SPAN)).select(F.size("hashes").alias("n"), "hashes")
    lengths = sorted(r[0] for r in short.select("n").distinct().collect())  # fewer than SPAN
    if not lengths:
        return documents.select("doc_id").where("false")

    def code(place: Column | int, n: int) -> Column:
        return F.xxhash64(F.lit(n), *[F.get(F.col("hashes"), place + i) for i in range(n)])

    def chosen(value: Column, place: Column) -> Column:
        out = code(place, lengths[-1])
        for i, n in enumerate(lengths[:-1]):
            out = F.when(value == i, code(place, n)).otherwise(out)
        return out

    of_items = F.lit(None).cast("long")
    for n in lengths:
        of_items = F.when(F.col("n") == n, code(F.lit(0), n)).otherwise(of_items)
    wanted = short.select(of_items.alias("code")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    many = len(lengths)
    texts = documents.select("doc_id", _hashed(F.col("text")).alias("hashes"))
    codes = F.transform(F.sequence(F.lit(0), F.size("hashes") * many - 1), lambda k: chosen(k % many, F.floor(k / many).cast("int")))
    rows = texts.select("doc_id", F.posexplode_outer(F.when(F.size("hashes") > 0, codes)).alias("k", "code")).where("code is not null")
    return rows.join(wanted, "code", "left_semi").select("doc_id").distinct()


def _filled(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id) of the documents in which an item of fewer than ``QUOTE`` words fills lines or sentences; one word has to be all there is."""

    def parts(text: Column) -> Column:
        """Words of each line or sentence, joined."""
        return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _ENDS), lambda x: F.array_join(words_of(x), " ")), lambda x: x != "")

    def code(parts: Column) -> Column:
        return F.xxhash64(F.array_join(parts, " "))

    short = benchmark.select(parts(F.col("text")).alias("parts")).withColumn("n_words", F.size(F.split(F.array_join("parts", " "), " ")))
    short = short.where((F.size("parts") > 0) & (F.col("n_words") < QUOTE)).select(F.size("parts").alias("n"), (F.col("n_words") == 1).alias("alone"), code(F.col("parts")).alias("code")).distinct()
    sizes = sorted(r[0] for r in short.select("n").distinct().collect())  # fewer than QUOTE
    if not sizes:
        return documents.select("doc_id").where("false")
    wanted = short.select("code", "alone").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = documents.select("doc_id", parts(F.col("text")).alias("parts"))

    def codes_of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda j: j <= F.size("parts") - (n - 1))
        return F.transform(starts, lambda j: code(F.slice("parts", j, n)))

    codes = F.flatten(F.array(*[codes_of(n) for n in sizes]))
    rows = texts.select("doc_id", F.when(F.size("parts") > 0, F.array_distinct(codes)).alias("codes"), code(F.col("parts")).alias("whole"))
    rows = rows.select("doc_id", "whole", F.explode_outer("codes").alias("code")).where("code is not null")
    return rows.join(wanted, "code").where(~F.col("alone") | (F.col("code") == F.col("whole"))).select("doc_id").distinct()


def passages(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id) of the documents that hold an item, a passage of one, pieces that add up to its share, or a short one whole."""
    items = benchmark.select("item_id", _hashed(F.col("text")).alias("hashes"))
    met = _meetings(documents, items)
    whole = _held(_laid_over(documents, items, met), share).select("doc_id")
    near = met.select("doc_id", "item_id", F.explode(F.sequence(F.col("shift") - NEAR, F.col("shift") + NEAR)).alias("shift")).distinct()
    places = written(_stretches(_laid_over(documents, items, near)), "stretches")

    pieces = places.groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("at").alias("n"))
    pieces = pieces.where((F.col("n") >= SPAN) & (F.col("n") >= F.ceil(F.lit(share) * F.col("n_item"))))
    close = places.select("doc_id", "item_id", "n_item", F.explode(F.sequence(F.col("shift") - NEAR, F.col("shift"))).alias("shift"), "at")
    close = close.groupBy("doc_id", "item_id", "n_item", "shift").agg(F.sort_array(F.collect_set("at")).alias("places"))  # no more than the item has words

    def longer(so_far: Column, at: Column) -> Column:
        now = F.greatest(so_far["now"] - GAP * (at - so_far["last"] - 1), F.lit(0)) + 1
        return F.struct(at.alias("last"), now.alias("now"), F.greatest(so_far["most"], now).alias("most"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))
    runs = close.where(F.aggregate("places", start, longer, lambda x: x["most"]) >= PASSAGE)
    return whole.union(pieces.select("doc_id")).union(runs.select("doc_id")).union(_quoted(documents, items)).union(_filled(documents, benchmark)).distinct()


def without_contaminated(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that hold no benchmark item and no passage of one, with all their columns."""
    found = passages(documents, benchmark, share).select(F.col("doc_id").alias("_found_id"))
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col("_found_id")), "left_anti")


def oracle_sql(documents: str = "documents", benchmark: str = "benchmark", share: float = SHARE) -> str:
    """The same in DuckDB: windows joined on their kept words, then counted word by word."""

    def words(table: str, key: str) -> str:
        return f"select {key}, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '') as w from {table}"

    def seeds(source: str, key: str, place: str) -> str:
        kept = lambda mask: " || ' ' || ".join(f"w[i + {k}]" for k, c in enumerate(mask) if c == "1")
        each = " union all ".join(f"select {key}, w, i as {place}, '{mask}:' || {kept(mask)} as seed from (select *, unnest(range(1, len(w) - {SPAN - 2})) as i from {source} where len(w) >= {SPAN})" for mask in MASKS)
        return each

    return f"""
    with d as ({words(documents, "doc_id")}), b as ({words(benchmark, "item_id")}),
    ds as ({seeds("d", "doc_id", "p")}), bs as ({seeds("b", "item_id", "q")}),
    met as (select distinct ds.doc_id, bs.item_id, ds.p - bs.q as shift, ds.w as dw, bs.w as bw from ds join bs on ds.seed = bs.seed),
    counted as (select doc_id, item_id, len(bw) as n_item,
      len(list_filter(range(1, len(bw) + 1), lambda j: j + shift >= 1 and j + shift <= len(dw) and dw[j + shift] = bw[j])) as n_matched from met)
    select doc_id, item_id, max(n_item)::bigint as n_item, max(n_matched)::bigint as n_matched from counted
    where n_matched >= {SPAN} and n_matched >= ceil({share} * n_item) group by doc_id, item_id
    """
