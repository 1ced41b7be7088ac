"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are trigrams of character classes (case, digits, blanks, line ends, marks by kind, other letters): the form of a
text, whatever its language. Term weights are (1 + log count) x inverse document frequency; a truncated singular value
decomposition of the labelled sample gives the latent axes. The labelled vectors are broadcast (``rows`` x DIMENSIONS
at most). Every document's cosine with all of them is computed exactly, in blocks of documents, and its K nearest vote
with weights sim^POWER.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.llm import common, labelled

DIMENSIONS = 48
K = 15
POWER = 8
CLASSES = 16
TERMS = CLASSES**3


def _class_table() -> np.ndarray:
    groups = ["", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "'\"`", "()[]{}<>", "|", "#*$%&~^", "-:;", "@/\\_=+"]
    table = np.zeros(256, np.int32)
    for k, chars in enumerate(groups):
        for c in chars:
            table[ord(c)] = k
    table[128:] = 15
    return table


_CLASS = _class_table()


def counts(text: str | None) -> np.ndarray:
    """How often each trigram of classes occurs in the whole text."""
    c = _CLASS[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    if len(c) < 3:
        c = np.concatenate([c, np.zeros(3 - len(c), np.int32)])
    return np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=TERMS)


def _weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0.0) * idf
    return (w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _leading(x: np.ndarray, k: int) -> np.ndarray:
    """The k leading right singular vectors, by subspace iteration: no more memory than a few columns beside ``x``."""
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(12):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v[:k].T).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int) -> dict | None:
    def tally(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            packed = [counts(t).astype(np.uint32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "counts"])

    # at most ``rows`` rows of 16 KB
    table = labelled.sample(docs, labels, "quality", rows).mapInArrow(tally, "doc_id long, label int, counts binary").toArrow().sort_by("doc_id")
    if not len(table):
        return None
    matrix = np.empty((len(table), TERMS), np.float32)
    for k, packed in enumerate(table.column("counts")):
        matrix[k] = np.frombuffer(packed.as_buffer(), np.uint32)
    wanted = np.array(table.column("label").to_pylist(), np.float32)
    del table
    idf = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(0))).astype(np.float32) + 1
    x = _weighted(matrix, idf)
    axes = _leading(x, min(DIMENSIONS, len(x)))
    return {"idf": idf, "axes": axes, "vectors": _unit(x @ axes), "labels": wanted}


def votes(texts: list[str | None], model: dict | None) -> np.ndarray:
    """Scores of a block of texts: 0.5 without a model."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x = _unit(_weighted(np.stack([counts(t) for t in texts]), model["idf"]) @ model["axes"])
    near = np.maximum(x @ model["vectors"].T, 0)
    k = min(K, near.shape[1])
    at = np.argpartition(near, -k, axis=1)[:, -k:]
    w = np.take_along_axis(near, at, 1).astype(np.float64) ** POWER
    total = w.sum(1)
    return np.clip(np.where(total > 0, (w * model["labels"][at]).sum(1) / np.maximum(total, 1e-300), 0.5), 0, 1)


def score(docs: DataFrame, labels: DataFrame, rows: int = 3_000, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, as labels.quality marks it.

    ``rows`` bounds the labelled sample. Empty and null texts are scored as a text of nothing. Without labelled rows all
    scores are 0.5. Repeated rows stay repeated.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, rows))

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = votes(batch.column("text").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = slim.mapInArrow(vote, "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, rows: int = 3_000, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``: repeated rows alike, null texts as a text
    of nothing. Without labelled rows all have 0.5, and stay if ``least`` isn't more."""
    spark = docs.sparkSession
    common.small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, rows))

    def sift(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(votes(batch.column("text").to_pylist(), model.value) >= least))

    return docs.mapInArrow(sift, docs.schema)
