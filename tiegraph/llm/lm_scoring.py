"""LM scoring by cross-entropy difference of a target and a background bigram model over one shared vocabulary.

Counts are exact and grow with the corpus: no table of them is ever in one place. Documents are written once in chunks of
about CHUNK characters. Each chunk counts its distinct words and pairs (a text begins with a mark) and deals them by their
96-bit hashes, which do not collide in practice (below 1e-8 at 10^10 keys), to buckets whose number grows with the
corpus. A bucket adds up what the chunks sent and answers each chunk with the counts of its own keys in the order they
came, so a common pair is one key a chunk, and a chunk scores its documents from the answers.

P(w|v) = LAMBDA c(v,w)/c(v) + (1 - LAMBDA) (c(w) + 1)/(N + V), where V is the number of distinct words, 2^VOCAB_BITS at
least (room for words never seen). A document's losses are mean -ln P per word; the score is target loss minus background
loss: lower is more like the target.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.llm import common

VOCAB_BITS = 18
PAIR_BITS = 21
LAMBDA = 0.7
#: Characters of a chunk of documents, and of the corpus for each bucket of keys.
CHUNK = 1 << 23
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def slots(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words of a text and of the pair that ends in each, for ``losses`` of small corpora."""
    h = np.array([0, *map(zlib.crc32, _words(text))], np.uint64)
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - VOCAB_BITS)
    two = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - PAIR_BITS)
    return one.astype(np.int64), two.astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<i8")


_CHUNKS = "chunk long, chars long, ids array<long>, texts binary"
_KEYS = "bucket long, chunk long, high binary, low binary, is_word binary, counts binary"
_ANSWERS = "bucket long, chunk long, counts binary, words long, total long, target_total long"
_LOSSES = "doc_id long, n_tokens long, target_loss double, background_loss double"


def _table(columns: list, schema: str) -> object:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def _gather(batches: Iterator, size: int) -> Iterator:
    """Chunks of documents: their words, a line for each."""
    import zstandard
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, lines, n = [], [], 0

    def chunk() -> Iterator:
        yield from _table([[number], [n], [ids], [zstandard.ZstdCompressor(level=3).compress(b"\n".join(lines))]], _CHUNKS).to_batches()

    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            lines.append(b" ".join(_words(t)))
            n += len(t) + 1  # empty texts fill a chunk, too
            if n >= size:
                yield from chunk()
                ids, lines, n, number = [], [], 0, number + 1
    if ids:
        yield from chunk()


class _Chunk:
    """Words and pairs of a chunk: ``words`` and ``pairs`` are the place of each word (the mark is a word) and of the pair
    that ends in it among the distinct ones; ``order`` sorts the keys of both (words first) by hash."""

    def __init__(self, texts: bytes) -> None:
        import zstandard

        flat: list[bytes] = []
        for line in zstandard.ZstdDecompressor().decompress(texts).split(b"\n"):
            flat.append(b"")
            flat += line.split()
        place = dict.fromkeys(flat)
        for k, w in enumerate(place):
            place[w] = k
        self.words = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        self.n_words = len(place)
        self.docs = np.cumsum(self.words == 0) - 1  # the mark comes first of all
        self.ends = np.flatnonzero(self.words)
        both, self.pairs = np.unique(self.words[self.ends - 1] * self.n_words + self.words[self.ends], return_inverse=True)
        hashes = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in place), "<u8").reshape(-1, 2)
        v, w = hashes[both // self.n_words], hashes[both % self.n_words]
        self.keys = np.concatenate([hashes, v * _MIX[:2] + w * _MIX[2:]]) >> np.array([0, 32], np.uint64)
        self.order = np.lexsort((self.keys[:, 1], self.keys[:, 0]))

    def counts(self, wanted: np.ndarray | None = None) -> np.ndarray:
        """How often each key is in the documents, or in those that are wanted."""
        w = np.ones(len(self.words)) if wanted is None else wanted[self.docs].astype(float)
        return np.concatenate([np.bincount(self.words, w, self.n_words), np.bincount(self.pairs, w[self.ends], len(self.keys) - self.n_words)]).astype(np.int64)


def _deal(batches: Iterator, buckets: int) -> Iterator:
    """Keys of each chunk with their counts, a row for each bucket of hashes."""
    bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    for batch in batches:
        for r in range(batch.num_rows):
            one = batch.slice(r, 1).to_pylist()[0]
            c = _Chunk(one["texts"])
            keys, is_word = c.keys[c.order], c.order < c.n_words
            wanted = np.zeros(c.docs[-1] + 1, bool)
            wanted[one["wanted"] or []] = True
            counts = np.stack([c.counts(), c.counts(wanted)])[:, c.order]
            ends = [0, *np.searchsorted(keys[:, 0], bounds), len(keys)]
            rows = [(b, x, y) for b, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if x < y]
            columns = [[b for b, _, _ in rows], [one["chunk"]] * len(rows), [_pack(np.diff(keys[x:y, 0], prepend=np.uint64(0))) for _, x, y in rows], [keys[x:y, 1].astype("<u4").tobytes() for _, x, y in rows], [np.packbits(is_word[x:y]).tobytes() for _, x, y in rows], [_pack(counts[:, x:y].ravel()) for _, x, y in rows]]
            yield from _table(columns, _KEYS).to_batches()


def _answer(rows: object) -> object:
    """Counts of a bucket's keys over all chunks, for each chunk those of its keys; also the bucket's words and their counts."""
    low = [np.frombuffer(x, "<u4") for x in rows.column("low").to_pylist()]
    high = [np.cumsum(_unpack(x).view(np.uint64), dtype=np.uint64) for x in rows.column("high").to_pylist()]
    whole = np.stack([np.concatenate(high), np.concatenate(low).astype(np.uint64)], axis=1)
    is_word = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(rows.column("is_word").to_pylist(), low, strict=True)]).astype(bool)
    counts = np.concatenate([_unpack(x).reshape(2, -1) for x in rows.column("counts").to_pylist()], axis=1)
    order = np.lexsort((whole[:, 1], whole[:, 0]))
    whole, is_word = whole[order], is_word[order]
    first = np.concatenate([[True], (whole[1:] != whole[:-1]).any(axis=1)])
    sums = np.add.reduceat(counts[:, order], np.flatnonzero(first), axis=1)
    counts[:, order] = sums[:, np.cumsum(first) - 1]
    ends = np.cumsum([0, *map(len, low)])
    n, mine = len(low), sums[:, is_word[first]]
    rest = [0] * (n - 1)  # what holds for the bucket is in its first row
    packed = [_pack(counts[:, x:y].ravel()) for x, y in zip(ends, ends[1:], strict=False)]
    return _table([rows.column("bucket").to_pylist(), rows.column("chunk").to_pylist(), packed, [mine.shape[1], *rest], [int(mine[0].sum()), *rest], [int(mine[1].sum()), *rest]], _ANSWERS)


def _losses(chunk: object, answers: object, vocabulary: int, totals: tuple[int, int]) -> object:
    """Losses of the documents of a chunk, from the counts of its keys."""
    one, got = chunk.to_pylist()[0], sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    c = _Chunk(one["texts"])
    counts = np.empty((2, len(c.keys)), np.int64)
    counts[:, c.order] = np.concatenate([_unpack(r["counts"]).reshape(2, -1) for r in got], axis=1)
    doc, n_docs = c.docs[c.ends], len(one["ids"])
    n = np.bincount(doc, minlength=n_docs)
    out = []
    for k in (1, 0):
        words, pairs = counts[k, : c.n_words], counts[k, c.n_words :]
        before, after = words[c.words[c.ends - 1]], words[c.words[c.ends]]
        p = LAMBDA * pairs[c.pairs] / np.maximum(before, 1) + (1 - LAMBDA) * (after + 1) / (totals[k] + vocabulary)
        mean = np.bincount(doc, -np.log(p), n_docs) / np.maximum(n, 1)
        out.append([float(x) if m else None for x, m in zip(mean, n, strict=True)])
    return _table([one["ids"], n.tolist(), *out], _LOSSES)


def losses(text: str | None, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """-ln P of each word of the text, by tables of ``slots`` without collisions."""
    words, pairs = model
    one, two = slots(text)
    before, after = words[one[:-1]], words[one[1:]]
    ratio = np.where(before > 0, np.minimum(pairs[two] / np.maximum(before, 1), 1.0), 0.0)
    return -np.log(LAMBDA * ratio + (1 - LAMBDA) * (after + 1) / (float(words.sum(dtype=np.float64)) + len(words)))


def score(docs: DataFrame, target: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of ``docs``.

    Both models are counted over all of ``docs``; the target's documents are those whose doc_id is in ``target``. Texts
    without words have no losses: both are null and the score is 0. Repeated rows stay repeated and count as often. An
    empty target leaves its model to the smoothing.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    chunks = common.materialize(texts.mapInArrow(partial(_gather, size=chunk), _CHUNKS), "lm-chunks", "none")
    buckets = max(24, (chunks.agg(F.sum("chars")).head()[0] or 0) // chunk)
    # ids alone meet the target's; compressed chunks, not texts, then meet the places found: the same joins at every size
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    places = chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id")).join(ids.hint("merge"), "doc_id", "leftsemi")
    wanted = places.groupBy("chunk").agg(F.collect_list("place").alias("wanted"))
    marked = chunks.select("chunk", "texts").join(wanted.hint("merge"), "chunk", "left")
    dealt = marked.select("chunk", "wanted", "texts").mapInArrow(partial(_deal, buckets=buckets), _KEYS)
    # the keys are most of what is shuffled: they go before chunks and answers meet
    answers = common.materialize(dealt.groupBy("bucket").applyInArrow(_answer, _ANSWERS), "lm-counts", "none", free=True)
    n = answers.agg(F.sum("words"), F.sum("total"), F.sum("target_total")).head()
    last = partial(_losses, vocabulary=max(n[0] or 0, 1 << VOCAB_BITS), totals=(n[1] or 0, n[2] or 0))
    apply = lambda chunk, answers: last(chunk, answers)  # noqa: E731 (cogroups want a function of two or three arguments)
    left, right = chunks.select("chunk", "ids", "texts"), answers.select("chunk", "bucket", "counts")
    scored = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(apply, _LOSSES)
    return scored.withColumn("score", F.coalesce(F.col("target_loss") - F.col("background_loss"), F.lit(0.0)))
