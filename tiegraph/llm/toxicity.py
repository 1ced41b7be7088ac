"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, pairs of neighbours, and pairs with one word between them.
Training keeps a rate per coordinate; L1 leaves few weights, and only those are broadcast. Scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiegraph.llm import common, labelled

BITS = 20
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def features(text: str | None) -> np.ndarray:
    """Hashes below 2^BITS, with repetitions: words, bigrams and skip-grams over one word. Empty texts have none."""
    words = _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    if not words:
        return np.zeros(0, np.int64)
    h = np.array(list(map(zlib.crc32, words)), np.uint64)
    one = h * np.uint64(0x9E3779B97F4A7C15)
    two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9))
    skip = (h[:-2] * np.uint64(0x27D4EB2F165667C5)) ^ (h[2:] * np.uint64(0x85EBCA77C2B2AE63))
    two *= np.uint64(0xFF51AFD7ED558CCD)
    skip *= np.uint64(0xC4CEB9FE1A85EC53)
    return (np.concatenate([one, two, skip]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: weights follow from z and n of each coordinate; index 2^BITS is the bias, which has no L1."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, np.int32(1 << BITS))
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def cut(self, rows: list[tuple[np.ndarray, int]]) -> float:
        """The log-odds at which fewest rows, not used for training, are on the wrong side: scores are centred there."""
        w = self.weights(np.arange((1 << BITS) + 1))
        z, y = np.array([w[at].sum() + w[-1] for at, _ in rows]), np.array([y for _, y in rows])
        if len(set(y.tolist())) < 2:
            return 0.0
        order = np.argsort(z, kind="stable")
        z, y = z[order], y[order]
        wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(1 - y[::-1])[::-1], [0]])
        best = np.flatnonzero(wrong == wrong.min())
        best = best[(best > 0) & (best < len(z))]
        if not len(best):
            return 0.0
        i = best[len(best) // 2]
        return float(np.clip((z[i - 1] + z[i]) / 2, -3, 3))

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at].astype(np.float32)


#: Different features of all training rows together: 4 bytes each on the driver.
FEATURES = 40_000_000


def train(docs: DataFrame, labels: DataFrame, rows: int = 10_000, passes: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and values of the weights, from at most ``rows`` labelled documents; None if there are none. Very long texts
    may make the sample smaller: documents, in order of a hash of their ids, are taken while they have at most FEATURES
    features in all (at least one is)."""
    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            packed = [np.unique(features(t)).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "at"])

    common.small_batches(docs.sparkSession)
    # bounded by ``rows``: the features of each row, not its text
    sample = common.materialize(labelled.sample(docs, labels, "toxic", rows).mapInArrow(hashed, "doc_id long, label int, at binary"), "toxic-rows")
    # a window over the lengths of at most ``rows`` rows
    sizes = sample.select("doc_id", F.length("at").alias("at")).withColumn("upto", F.sum("at").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))
    taken = sizes.where((F.col("upto") <= 4 * FEATURES) | (F.col("upto") == F.col("at"))).select("doc_id")
    table = sample.join(F.broadcast(taken), "doc_id").toArrow().sort_by("doc_id")
    if not len(table):
        return None
    # views of the collected buffers, no copies
    rows_ = [(np.frombuffer(a.as_buffer(), np.int32), y) for a, y in zip(table.column("at"), table.column("label").to_pylist(), strict=True)]
    cut = _fit([r for k, r in enumerate(rows_) if k % 4], passes).cut([r for k, r in enumerate(rows_) if k % 4 == 0])
    at, w = _fit(rows_, passes).sparse()
    if not len(at) or at[-1] != 1 << BITS:
        at, w = np.append(at, np.int32(1 << BITS)), np.append(w, np.float32(0))
    w[-1] -= cut
    return at, w


def _fit(rows: list[tuple[np.ndarray, int]], passes: int) -> Ftrl:
    model, rng = Ftrl(), np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            model.learn(*rows[i])
    return model


def score(docs: DataFrame, labels: DataFrame, rows: int = 10_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, as labels.toxic marks it.

    Empty and null texts get the bias alone. Without labelled rows all scores are 0. Repeated rows stay repeated.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, rows))
    dense: dict[int, np.ndarray] = {}

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if 0 not in dense and model.value is not None:
            dense[0] = np.zeros((1 << BITS) + 1, np.float32)
            dense[0][model.value[0]] = model.value[1]
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if model.value is None:
                    out.append(0.0)
                    continue
                at = features(text)
                at = np.unique(at[dense[0][at] != 0])
                out.append(float(1 / (1 + np.exp(-np.clip(float(dense[0][at].sum()) + float(dense[0][-1]), -35, 35)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = slim.mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
