"""Mixture-controlled packing: deficit round-robin over the queues of the sources, without a sequential loop.

A window of ``window_tokens`` is one round. In a round, source s gets a quantum of (its share x window) tokens, adds
what it did not use before (its deficit), and sends documents while its balance covers them. While a queue has
documents, that sends a document in round ceil(E / quantum), E being the queue's tokens up to and with it: deficits
carry over windows and partitions in E, a running sum taken in parts. The rounds, then the sources, then the queues
give one stream of tokens, cut every ``length`` ids: only the last sequence has padding.

Shares default to the sources' own shares of all tokens. A missing source is a source of its own. Given shares must be
positive and name every source of the documents; anything else is an error, since its documents would have no place.
A queue that empties leaves its share of the later windows to the others. Documents with no
text are their end id. Repeated rows are packed as often as they come. No rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.llm import common, tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, window_tokens: int = 64 * 2048, shares: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents of ``docs`` (doc_id, text, source): see PIECES."""
    spark = docs.sparkSession
    common.small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"), F.col("source").cast("string").alias("source"))

    def encode(batches: Iterator) -> Iterator:
        return tokens.token_rows(batches, tokenizer_path, end_id, ("doc_id", "source"))

    stored = common.materialize(slim.mapInArrow(encode, "doc_id long, source string, uid long, n_tokens long, ids binary"), "packed-ids", "none")
    narrow = stored.select("uid", "source", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_ord"), "n_tokens")
    queued = common.running_start(narrow, ["_ord", "uid"], "n_tokens", "_before", ["source"])
    per_source = narrow.groupBy("source").agg(F.sum("n_tokens").alias("_all")).select(F.col("source").alias("_source"), "_all")
    total = per_source.agg(F.sum("_all").alias("_total"))
    if shares is not None:
        if not shares or min(shares.values()) <= 0:
            raise ValueError("shares must be positive")
        wanted = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v) / sum(shares.values())))])
        share = wanted[F.col("source")]
        unnamed = per_source.where(F.col("_source").isNull() | wanted[F.col("_source")].isNull()).limit(1).collect()
        if unnamed:
            raise ValueError(f"no share for source {unnamed[0]['_source']}")
    else:
        share = F.col("_all") / F.col("_total")
    quantum = share * window_tokens
    rounds = queued.join(per_source, F.col("source").eqNullSafe(F.col("_source")), "left").join(F.broadcast(total)).withColumn("window", F.ceil((F.col("_before") + F.col("n_tokens")) / quantum).cast("long"))
    placed = common.running_start(rounds.select("uid", "source", "window", "_before", "n_tokens"), ["window", "source", "_before", "uid"], "n_tokens", "_at")
    # a merge join at every size: the texts' ids are moved once, never sent whole to each task
    both = stored.select("uid", "doc_id", "source", "ids").join(placed.select("uid", "window", "_at").hint("merge"), "uid")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        dtype = tokens.encoder(tokenizer_path).dtype
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, source, packed, window, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "ids", "window", "_at")), strict=True):
                ids = tokens.decompress(packed, dtype).astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, length)
                    piece = ids[start : start + length - offset]
                    for out, x in zip(rows, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), sequence, offset, source, window), strict=True):
                        out.append(x)
                    start += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if c == "source" else pa.int64()) for c, x in zip(names, rows, strict=True)], names)

    return both.mapInArrow(cut, PIECES)
