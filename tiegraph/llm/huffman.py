"""Token ids as canonical length-limited Huffman codes: blocks that decode on their own, with bit-offset checkpoints.

File format (a folder). ``codes``: one row, the code length of each id (0: not used). ``blocks``: rows (part, block,
n_ids, doc_ids, doc_lengths, checkpoints, payload), in Parquet, files and rows in ascending doc_id order. A payload is
the codes of n_ids ids, most significant bit first; ``checkpoints`` holds the bit offset of every STRIDE-th id (32 bits), so
that a reader can start anywhere. Lengths are limited to LIMIT bits, so one table of 2^LIMIT entries decodes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegraph.llm import common, tokens

STRIDE = 128
BLOCK_IDS = 1 << 16
BLOCKS = "part long, block long, n_ids long, doc_ids binary, doc_lengths binary, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the symbols with counts > 0 (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = limit or max(16, int(np.ceil(np.log2(len(used)))) + 2)
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for the length limit")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # levels[k]: whether each item of the merged list is a leaf; packages pair neighbours of the level below
    merged, levels = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank < n)
    take = 2 * n - 2
    out = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        first = leaf[:take]
        k = int(first.sum())
        out[:k] += 1
        take = 2 * (take - k)
    lengths[order] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[s]:
            code <<= int(lengths[s]) - last
            last = int(lengths[s])
            codes[s] = code
            code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payload of ``ids`` and the bit offset of each."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 3, np.uint64)
    # a code of up to 32 bits lies in two neighbouring 32-bit words
    shifted = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    np.add.at(words, at >> 5, shifted >> np.uint64(32))
    np.add.at(words, (at >> 5) + 1, shifted & np.uint64(0xFFFFFFFF))
    return words.astype(">u4").tobytes()[: (total + 7) // 8], at


class Table:
    """Decodes by one look-up per id, many checkpoints side by side."""

    def __init__(self, lengths: np.ndarray):
        self.limit = max(1, int(lengths.max(initial=1)))
        codes = canonical(lengths)
        self.symbol, self.size = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        for s in np.flatnonzero(lengths):
            n = int(lengths[s])
            lo = int(codes[s]) << (self.limit - n)
            hi = lo + (1 << (self.limit - n))
            self.symbol[lo:hi], self.size[lo:hi] = s, n

    def decode(self, payload: bytes, n_ids: int, checkpoints: np.ndarray) -> np.ndarray:
        data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint64)
        # the 40 bits from each byte on
        words = (data[:-4] << np.uint64(32)) | (data[1:-3] << np.uint64(24)) | (data[2:-2] << np.uint64(16)) | (data[3:-1] << np.uint64(8)) | data[4:]
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((len(at), STRIDE), np.uint32)
        shift = np.uint64(40 - self.limit)
        mask = np.uint64((1 << self.limit) - 1)
        last = 8 * len(payload)
        for k in range(STRIDE):
            at = np.minimum(at, last)
            look = ((words[at >> 3] >> (shift - (at & 7).astype(np.uint64))) & mask).astype(np.int64)
            out[:, k] = self.symbol[look]
            at = at + self.size[look]
        return out.reshape(-1)[:n_ids]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode all documents of ``docs`` (doc_id, text) into the folder ``path``. A missing text is empty, a missing id last."""
    spark = docs.sparkSession
    common.small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"))

    def encode(batches: Iterator) -> Iterator:
        return tokens.token_rows(batches, tokenizer_path, end_id, ("doc_id",))

    stored, stored_path = common.stash(slim.mapInArrow(encode, "doc_id long, uid long, n_tokens long, ids binary"), "token-ids", "none")

    def tally(batches: Iterator) -> Iterator:
        import pyarrow as pa

        dtype = tokens.encoder(tokenizer_path).dtype
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.bincount(np.concatenate([tokens.decompress(p, dtype) for p in batch.column("ids").to_pylist()]), minlength=len(counts))
            if len(more) > len(counts):
                counts = np.pad(counts, (0, len(more) - len(counts)))
            counts += more
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])

    # one row per id of the vocabulary reaches the driver
    rows = stored.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        dtype = tokens.encoder(tokenizer_path).dtype
        lengths, codes = shared.value
        part, block, ids, who = TaskContext.get().partitionId(), 0, [], []

        def flush() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            payload, at = pack_bits(whole, codes, lengths)
            row = {"part": part, "block": block, "n_ids": len(whole), "doc_ids": np.array([-(2**63) if d is None else d for d in who], "<i8").tobytes(), "doc_lengths": np.array([len(x) for x in ids], "<u4").tobytes(), "checkpoints": at[::STRIDE].astype("<u4").tobytes(), "payload": payload}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()})

        held = 0
        for batch in batches:
            for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(tokens.decompress(packed, dtype))
                who.append(doc)
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    block, ids, who, held = block + 1, [], [], 0
        if ids:
            yield flush()

    ordered = stored.withColumn("_ord", F.coalesce("doc_id", F.lit(2**63 - 1))).repartitionByRange("_ord", "uid").sortWithinPartitions("_ord", "uid")
    ordered.select("doc_id", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    common.drop_folder(spark, stored_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the folder: doc_id, start, n_tokens, ids_crc32, from the decoded blocks."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codes").head()["lengths"], np.uint8)
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    tables: dict[int, Table] = {}

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = tables.setdefault(0, Table(shared.value))
        for batch in batches:
            for r in batch.to_pylist():
                ids = table.decode(r["payload"], r["n_ids"], np.frombuffer(r["checkpoints"], "<u4")).astype("<u4")
                n = np.frombuffer(r["doc_lengths"], "<u4").astype(np.int64)
                start = np.cumsum(n) - n
                crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(start, n, strict=True)]
                who = [None if d == -(2**63) else d for d in np.frombuffer(r["doc_ids"], "<i8").tolist()]
                cols = [pa.array([r["part"]] * len(n), pa.int64()), pa.array([r["block"]] * len(n), pa.int64()), pa.array(who, pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "block", "doc_id", "_local", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(decode, "part long, block long, doc_id long, _local long, n_tokens long, ids_crc32 long")
    begins = common.running_start(blocks.select("part", "block", "n_ids"), ["part", "block"], "n_ids", "_begin").select("part", "block", "_begin")
    return found.join(begins, ["part", "block"]).select("doc_id", (F.col("_begin") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32")
