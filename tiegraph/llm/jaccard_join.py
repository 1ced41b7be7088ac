"""N-gram Jaccard self-join of documents by a blocked sparse product of the document by n-gram incidence.

1. Each text becomes its set of shingle hashes; equal sets are one class (n, digest), so copies count once.
2. The incidence matrix is dealt out in column blocks (ranges of the hash). A block sums its columns: an n-gram that
   only one class has adds to no product and is dropped; the others go back to their rows with the column's sum.
3. A row whose kept entries are fewer than ceil(t n), the overlap that any partner needs, has no partner: dropped.
4. Entries are ordered by (column sum, hash), rarest first. Two linked rows share an entry among their first
   n - ceil(t n) + 1, so only these columns are multiplied. Products between rows whose sizes exclude the threshold
   are discarded, overlaps of the rest are counted over all kept entries, and pairs below the bound are discarded.
5. Columns with very many rows (large groups of near copies) aren't multiplied out: every row of a column meets a
   pivot, the links found so far join rows to components, and only pairs of a column in different components remain.
   A pair left out lies in one component already, so components are those of all links. In the end each row outside
   a column's largest component meets all rows of the column. A parity bitmap of each row's entries bounds the
   symmetric difference of two rows from below, so pairs that can't link are discarded inside the join.

Words, shingles and links are defined in ``shingle_hashes`` and ``linked_components``. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiegraph.llm import common
from tiegraph.operators.components import connected_components

ENTRIES_PER_BLOCK = 3_000_000
ENTRIES_PER_FLUSH = 4_000_000
PIVOT_ROUNDS = 3
SKETCH_WORDS = 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of all words if there are fewer; none without words.

    A-Z become lower case; words are runs of characters other than space and the control characters 9 to 13.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def class_id(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, ids = [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, size)
                n.append(len(h))
                ids.append(class_id(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "n", "cid"])

    return docs.mapInArrow(measure, "doc_id long, n long, cid long")


def _columns(docs: DataFrame, size: int, blocks: int) -> DataFrame:
    """The incidence matrix in column blocks: hashes ascending (differences of the upper 48 bits, and the lower 16), for each
    the index of its class."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] = []
        ids: list[int] = []
        seen: set[int] = set()

        def flush() -> Iterator:
            sizes = np.array([len(h) for h in held])
            h = np.concatenate(held)
            who = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            order = np.argsort(h)
            h, who = h[order], who[order]
            block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            edge = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
            cids = np.array(ids, np.int64)
            cols: dict[str, list] = {k: [] for k in ("block", "steps", "low", "who", "cids", "sizes")}
            for b in range(blocks):
                lo, hi = edge[b], edge[b + 1]
                if lo < hi:
                    used, index = np.unique(who[lo:hi], return_inverse=True)
                    steps = np.diff(h[lo:hi] >> np.uint64(16), prepend=np.uint64(0))
                    first, rest = steps[:1], steps[1:]
                    rest = rest.astype(np.uint32) if not len(rest) or rest.max() < 1 << 32 else rest
                    for k, v in zip(cols, (b, first.tobytes() + rest.tobytes(), (h[lo:hi] & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), index.astype(np.uint16).tobytes(), cids[used].tobytes(), sizes[used].astype(np.uint32).tobytes()), strict=True):
                        cols[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "block" else pa.binary()) for k, v in cols.items()], list(cols))
            held.clear()
            ids.clear()

        total = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, size)
                if not len(h) or (cid := class_id(h)) in seen:
                    continue
                if len(seen) > 1_000_000:  # copies that a task forgets are merged in the block
                    seen.clear()
                seen.add(cid)
                held.append(h)
                ids.append(cid)
                total += len(h)
                if total >= ENTRIES_PER_FLUSH or len(held) >= 65_000:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(deal, "block long, steps binary, low binary, who binary, cids binary, sizes binary")


def _shared_entries(columns: DataFrame, parts: int) -> DataFrame:
    """For each column of at least two classes its entries, dealt out by class."""

    def total(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        hs, cs, ns = [], [], []
        for steps, low, who, cids, sizes in zip(*(table.column(c).to_pylist() for c in ("steps", "low", "who", "cids", "sizes")), strict=True):
            index = np.frombuffer(who, np.uint16)
            first, rest = np.frombuffer(steps[:8], np.uint64), steps[8:]
            wide = np.frombuffer(rest, np.uint32 if len(rest) == 4 * (len(index) - 1) else np.uint64)
            hs.append(np.cumsum(np.concatenate([first, wide.astype(np.uint64)]), dtype=np.uint64) << np.uint64(16) | np.frombuffer(low, np.uint16))
            cs.append(np.frombuffer(cids, np.int64)[index])
            ns.append(np.frombuffer(sizes, np.uint32)[index])
        h, c, n = np.concatenate(hs), np.concatenate(cs), np.concatenate(ns)
        del hs, cs, ns
        order = np.lexsort((c, h))
        h, c, n = h[order], c[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c, n = h[new], c[new], n[new]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sums = np.diff(np.append(starts, len(h)))
        df = np.repeat(sums, sums)
        keep = df > 1
        h, c, n, df = h[keep], c[keep], n[keep], df[keep]
        part = ((c.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.lexsort((c, part))
        h, c, n, df, part = h[order], c[order], n[order], df[order], part[order]
        edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        cols: dict[str, list] = {k: [] for k in ("part", "cids", "counts", "sizes", "h", "df")}
        for p in range(parts):
            lo, hi = edge[p], edge[p + 1]
            if lo < hi:
                used, at, counts = np.unique(c[lo:hi], return_index=True, return_counts=True)
                for k, v in zip(cols, (p, used.tobytes(), counts.astype(np.uint32).tobytes(), n[lo:hi][at].tobytes(), h[lo:hi].tobytes(), df[lo:hi].astype(np.uint32).tobytes()), strict=True):
                    cols[k].append(v)
        return pa.Table.from_arrays([pa.array(v, pa.int64() if k == "part" else pa.binary()) for k, v in cols.items()], list(cols))

    return columns.groupBy("block").applyInArrow(total, "part long, cids binary, counts binary, sizes binary, h binary, df binary")


def _rows(entries: DataFrame, percent: int) -> DataFrame:
    """(cid, n, shared): a class's entries, rarest first, if they suffice for any partner."""

    def gather(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        hs, cs, ns, dfs = [], [], [], []
        for cids, counts, sizes, h, df in zip(*(table.column(c).to_pylist() for c in ("cids", "counts", "sizes", "h", "df")), strict=True):
            k = np.frombuffer(counts, np.uint32)
            cs.append(np.repeat(np.frombuffer(cids, np.int64), k))
            ns.append(np.repeat(np.frombuffer(sizes, np.uint32), k))
            hs.append(np.frombuffer(h, np.int64))
            dfs.append(np.frombuffer(df, np.uint32))
        h, c, n, df = np.concatenate(hs), np.concatenate(cs), np.concatenate(ns).astype(np.int64), np.concatenate(dfs)
        _, index, counts = np.unique(c, return_inverse=True, return_counts=True)
        keep = 100 * counts[index] >= percent * n
        h, c, n, df = h[keep], c[keep], n[keep], df[keep]
        order = np.lexsort((h, df, c))
        h, c, n = h[order], c[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        bits = np.zeros((len(starts), SKETCH_WORDS), np.uint64)
        which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        mixed = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        np.bitwise_xor.at(bits, (which, (mixed & np.uint64(SKETCH_WORDS - 1)).astype(np.int64)), np.uint64(1) << (mixed >> np.uint64(10) & np.uint64(63)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)), pa.int32()), pa.array(h, pa.int64()))
        words = [pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(SKETCH_WORDS)]
        return pa.Table.from_arrays([pa.array(c[starts]), pa.array(n[starts]), lists, *words], ["cid", "n", "shared", *(f"w{k}" for k in range(SKETCH_WORDS))])

    return entries.groupBy("part").applyInArrow(gather, "cid long, n long, shared array<long>" + "".join(f", w{k} long" for k in range(SKETCH_WORDS)))


def _sketch(rows: DataFrame, side: str) -> DataFrame:
    """Per class: its size, how many of its entries nobody shares, and the parity bitmap of the others."""
    words = [F.col(f"w{k}").alias(f"w{k}{side}") for k in range(SKETCH_WORDS)]
    return rows.select(F.col("cid").alias(side), F.col("n").alias(f"n{side}"), (F.col("n") - F.size("shared")).alias(f"u{side}"), *words)


def _may_link(percent: int) -> Column:
    """Whether the least possible symmetric difference of a and b still allows a link. Also bounds their sizes."""
    apart = F.col("ua") + F.col("ub")
    for k in range(SKETCH_WORDS):
        apart = apart + F.bit_count(F.col(f"w{k}a").bitwiseXOR(F.col(f"w{k}b")))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return fits & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those with overlap of at least ``percent`` of the union."""
    left = rows.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = rows.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    overlap = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", overlap.alias("overlap"))
    return joined.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))


def linked_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cid) of all rows, and (cid, component) of the classes that have a link.

    Classes link when 100 * overlap >= percent * union of their sets; component is the same for all reachable ones.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    sets = common.materialize(_sets(slim, size), "jaccard-sets")
    entries = sets.agg(F.sum("n")).head()[0] or 0
    blocks = max(16, -(-entries // ENTRIES_PER_BLOCK))
    rows = common.materialize(_rows(_shared_entries(_columns(slim, size, blocks), blocks), percent), "jaccard-rows")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    prefix = rows.select("cid", (F.col("n") - F.size("shared")).alias("own"), F.explode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), first.cast("int")))).alias("h"))
    shared = prefix.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1").select("h")
    prefix = common.materialize(prefix.join(shared, "h"), "jaccard-prefix")
    count = prefix.count()
    comps = prefix.select("cid", F.col("cid").alias("comp")).distinct()
    for turn in range(PIVOT_ROUNDS + 1):
        open_ = prefix.join(comps, "cid")
        per = open_.groupBy("h", "comp").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("rows"), F.count("*").alias("comps"))
        mixed = common.materialize(per.where("comps > 1").select("h", F.col("main.comp").alias("main"), (F.col("rows") - F.col("main.k")).alias("others"), "rows"), "jaccard-mixed")
        rest = mixed.agg(F.sum(F.col("others") * F.col("rows"))).head()[0] or 0
        if not rest:
            break
        open_ = common.materialize(open_.join(mixed.select("h", "main"), "h"), "jaccard-open")
        last = rest <= 4 * count or turn == PIVOT_ROUNDS
        if last:
            one = open_.where("comp <> main").select("h", F.col("cid").alias("a"), F.col("comp").alias("ca"), "main").join(_sketch(rows, "a"), "a")
            two = open_.select("h", F.col("cid").alias("b"), F.col("comp").alias("cb")).join(_sketch(rows, "b"), "b")
            # both ends outside the main component: once; one end in it: always
            new = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("ca") < F.col("cb")))
            pairs = one.join(two, "h").where(new & _may_link(percent)).select("a", "b")
        else:
            # the row with the least of its own is nearest to the text that the copies come from; later, of those not yet joined
            rank = F.struct("own", F.xxhash64("cid"), F.col("cid").alias("b"), F.col("comp").alias("cb"))
            pivots = (open_.where("comp <> main") if turn else open_).groupBy("h").agg(F.min(rank).alias("p")).select("h", "p.b", "p.cb")
            pairs = open_.select("h", F.col("cid").alias("a"), F.col("comp").alias("ca")).join(pivots, "h").where("ca <> cb").select("a", "b").distinct()
            pairs = pairs.join(_sketch(rows, "a"), "a").join(_sketch(rows, "b"), "b").where(_may_link(percent)).select("a", "b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = _verified(pairs, rows, percent).select("a", "b")
        # links between components, which then merge
        for end in "ab":
            found = found.join(comps.select(F.col("cid").alias(end), F.col("comp").alias(f"c{end}")), end)
        found = common.materialize(found.select("ca", "cb").where("ca <> cb").distinct(), "jaccard-links")
        if not found.isEmpty():
            merged = connected_components(found, "ca", "cb").select(F.col("node").alias("comp"), F.col("component").alias("to"))
            comps = common.materialize(comps.join(merged, "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp")), "jaccard-comps")
        if last:
            break
    return sets, comps


def linked_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. Rows without words (null, empty or
    blank texts) have 0 shingles and link with nothing. Repeated rows stay repeated. A row without doc_id takes part;
    its component_id is null only if no row of its component has an id. No rows give no rows.
    """
    sets, comps = linked_classes(docs, size, percent)
    keyed = sets.join(comps, "cid", "left").withColumn("_group", F.coalesce("comp", "cid"))
    least = keyed.where("_group is not null").groupBy("_group").agg(F.min("doc_id").alias("_least"))
    out = keyed.join(least, "_group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component; one of repeated rows; rows without id stay."""
    found = common.materialize(linked_components(docs.select("doc_id", "text"), size, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("component_id"), F.count("*").alias("rows")), "jaccard-kept")
    gone = found.where("doc_id <> component_id").select("doc_id")
    # the ids that go grow with the corpus: they meet the documents in a shuffle at every size
    kept = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id = component_id and rows > 1").select("doc_id")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)
