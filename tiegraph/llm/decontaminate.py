"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Words are runs of letters and digits, in lower case; shingles are five words (all words of a shorter item).

1. Windows. Every window of an item's number of words that holds a shingle of any item of that size is examined, at
   every start; a window without one has similarity 0 with all items. A window less than ``threshold`` of whose weight is
   in shingles of items can't be as similar as that to any. Equal windows of different documents are one from here on.
2. Each window has a 64-bit SimHash of its shingles, weighted by their letters. The bits are cut into RADIUS + 1
   blocks: two hashes within RADIUS agree in a block, so joining on (window size, block, bits) finds all items of the
   window's size within the radius, and bit counts discard the rest.
3. The weighted Jaccard similarity of the shingles of window and item, exact, must be at least ``threshold``.

At similarity 0.8 the hashes differ in 9 to 10 of 64 bits on average; RADIUS is three standard deviations more. Blocks of
3 or 4 bits follow from that radius: they leave one item of a size in two or three to be compared by bit counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiegraph.llm import common

SHINGLE = 5
#: Item shingles that one pass sends to every task: 24 bytes each, 48 MB.
KEYS = 2_000_000
RADIUS = 18
BITS = 64
_WIDTHS = [BITS // (RADIUS + 1) + (k < BITS % (RADIUS + 1)) for k in range(RADIUS + 1)]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def once(column: Column) -> Column:
    """The same value through a Generate, so that it is computed once however often it is used."""
    return F.explode(F.array(column))


def shingles(words: Column, size: int) -> Column:
    """The shingles of an array of words, as strings, in order."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, size: int) -> Column:
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(texts: Column) -> Column:
    """64-bit SimHash of an array of distinct shingles, weighted by their lengths."""
    votes = F.transform(texts, lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).alias("w")))
    one = lambda b: F.aggregate(votes, F.lit(0), lambda acc, v: acc + F.when(F.getbit(v["h"], b) == 1, v["w"]).otherwise(-v["w"]))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(one(b) > 0, F.lit("1")).otherwise(F.lit("0")))
    return F.array_join(bits, "")


def blocks(bits: Column) -> Column:
    """RADIUS + 1 pieces of a SimHash given as a string of bits, each with its number."""
    at, out = 1, []
    for k, width in enumerate(_WIDTHS):
        out.append(F.struct(F.lit(k).alias("k"), F.substring(bits, at, width).alias("v")))
        at += width
    return F.array(*out)


def hamming(a: Column, b: Column) -> Column:
    as_long = lambda x: F.conv(x, 2, -10).cast("bigint")
    halves = [F.bit_count(as_long(F.substring(a, i, 32)).bitwiseXOR(as_long(F.substring(b, i, 32)))) for i in (1, 33)]
    return halves[0] + halves[1]


def weight(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0), lambda acc, s: acc + F.length(s))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, window_start, similarity): every document that holds a passage like an item, its best window.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Texts that are null or have no
    words, and rows without doc_id or item_id, leak nothing. Repeated rows give one result. window_start counts words.
    """
    named = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), once(words_of(F.col("text"))).alias("words")).distinct()
    named = named.where(F.size("words") > 0).withColumn("n_words", F.size("words"))
    parts = None
    sizes = [r["s"] for r in named.select(F.least(F.lit(SHINGLE), F.col("n_words")).alias("s")).distinct().collect()]  # 1 to SHINGLE
    for size in sizes:
        some = named.where(F.least(F.lit(SHINGLE), F.col("n_words")) == size)
        some = some.select("item_id", "n_words", once(F.array_distinct(shingles(F.col("words"), size))).alias("texts"), shingle_hashes(F.col("words"), size).alias("hashes"), F.lit(size).alias("size"))
        parts = some if parts is None else parts.unionByName(some)
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if parts is None:
        return slim.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("window_start"), F.lit(0.0).alias("similarity"))
    prints = common.materialize(parts.withColumn("bits", simhash(F.col("texts"))), "item-prints")
    keys = common.materialize(prints.select("n_words", "size", F.explode("hashes").alias("h")).distinct(), "item-shingles")
    # item shingles go to every task, at most KEYS at a time: more are further passes over the documents, not a shuffle of them
    passes = max(1, -(-keys.count() // KEYS))
    hits = None
    for size in sizes:
        for part in range(passes):
            some = keys.where((F.col("size") == size) & (F.pmod(F.col("h"), F.lit(passes)) == part)).select("h", "n_words")
            at = slim.select("doc_id", once(words_of(F.col("text"))).alias("words")).select("doc_id", "words", F.posexplode(shingle_hashes(F.col("words"), size)).alias("pos", "h"))
            found = at.join(F.broadcast(some), "h").select("doc_id", "n_words", F.lit(size).alias("size"), "pos")
            hits = found if hits is None else hits.unionByName(found)
    hits = common.materialize(hits.groupBy("doc_id", "n_words", "size").agg(F.collect_set("pos").alias("hits")), "leak-hits")
    # texts meet their hits in a shuffle at every size: the documents with hits grow with the corpus
    texts = slim.join(hits.hint("shuffle_hash"), "doc_id").select("doc_id", "n_words", "size", "hits", once(words_of(F.col("text"))).alias("words"))
    windows = None
    for size in sizes:
        rows = texts.where(F.col("size") == size).select("doc_id", "n_words", "hits", once(shingles(F.col("words"), size)).alias("all"))
        width = F.col("n_words") - size + 1
        starts = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(F.greatest(p - F.col("n_words") + size, F.lit(0)), p))))
        window = lambda at: F.struct(at.alias("start"), F.array_distinct(F.slice("all", at + 1, width)).alias("texts"), F.array_distinct(F.transform(F.filter("hits", lambda p: (p >= at) & (p < at + width)), lambda p: F.get("all", p))).alias("shared"))  # noqa: B023, E731
        # what an item shares with a window is among the window's hits: their share of its weight bounds the similarity
        able = F.filter(F.transform(starts, window), lambda w: weight(w["shared"]) >= threshold * weight(w["texts"]))
        some = rows.select("doc_id", "n_words", F.explode(able).alias("w")).select("doc_id", "n_words", "w.start", "w.texts")
        windows = some if windows is None else windows.unionByName(some)
    # equal windows, wherever they are, are one: 128 bits name their shingles
    name = F.struct(F.xxhash64("texts").alias("a"), F.xxhash64(F.lit(1), "texts").alias("b")).alias("name")
    windows = common.materialize(windows.select("doc_id", "n_words", "start", name, "texts"), "leak-windows")
    once_each = windows.groupBy("n_words", "name").agg(F.first("texts").alias("texts"))
    unique = common.materialize(once_each.select("n_words", "name", "texts", simhash(F.col("texts")).alias("bits")), "leak-prints")
    probe = unique.select("n_words", "name", "bits", F.explode(blocks(F.col("bits"))).alias("block")).select("n_words", "name", "bits", "block.k", "block.v")
    index = prints.select("item_id", "n_words", F.col("bits").alias("item_bits"), F.explode(blocks(F.col("bits"))).alias("block")).select("item_id", "n_words", "item_bits", "block.k", "block.v")
    near = probe.join(index, ["n_words", "k", "v"]).where(hamming(F.col("bits"), F.col("item_bits")) <= RADIUS).select("n_words", "name", "item_id").distinct()
    both = near.join(unique.select("n_words", "name", "texts"), ["n_words", "name"]).join(prints.select("item_id", F.col("texts").alias("item_texts")), "item_id")
    common_weight = weight(F.array_intersect("texts", "item_texts"))
    alike = both.select("n_words", "name", "item_id", (common_weight / weight(F.array_union("texts", "item_texts"))).alias("similarity")).where(F.col("similarity") >= threshold)
    scored = windows.select("doc_id", "n_words", "start", "name").join(alike, ["n_words", "name"])
    best = scored.groupBy("doc_id", "item_id").agg(F.min(F.struct(-F.col("similarity"), F.col("start"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").alias("window_start"), (-F.col("best.col1")).alias("similarity"))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that leak no item; rows without doc_id, and with null texts, stay, as often as they come. The ids
    that leak grow with the corpus, so they meet the documents in a shuffle at every size."""
    found = common.materialize(leaks(docs.select("doc_id", "text"), items, threshold).select("doc_id").distinct(), "leaking")
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
