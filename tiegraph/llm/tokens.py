"""Token ids of whole texts with the ``tokenizers`` library, through a cache of word pieces.

Both public vocabularies split texts into pre-tokens that never reach over one plain space between two characters
that aren't white space, so the ids of a text are the ids of its space-separated chunks in order. Words repeat, so
each worker encodes a chunk once with the library and then looks it up. Texts in which a space touches other white
space are split only at the safe places. The cache is bounded by ``CACHE_WORDS`` and emptied when full.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

CACHE_WORDS = 1_000_000
LONG_CHUNK = 48
#: Marks that may follow the letters of a chunk as a pre-token of their own; not the apostrophe, which contractions have.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TOUCHING = re.compile(r" \s|\s ")
_OTHER_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _touches(text: str) -> bool:
    """Whether a space lies beside other white space; plain substring searches decide it for most texts."""
    if text.isascii():
        if "  " in text or " \n" in text or "\n " in text:
            return True
        if not any(c in text for c in _OTHER_BLANKS):
            return False
    return bool(_TOUCHING.search(text))


class ChunkEncoder:
    """``encode(texts)`` gives for each text its ids as little-endian bytes of ``dtype`` (16 bits if the vocabulary fits)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # with a pre-tokenizer that drops white space, chunks need no space before them and lines split too
        self.keeps_space = self.tokenizer.encode("a b", add_special_tokens=False).ids != (
            self.tokenizer.encode("a", add_special_tokens=False).ids + self.tokenizer.encode("b", add_special_tokens=False).ids
        )
        self.lead = " " if self.keeps_space else ""
        self.cache: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        # ids that begin a word (with its space) or end one (with the suffix of word ends)
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        for token, k in self.tokenizer.get_vocab().items():
            self.edge[k] = token.startswith("\u0120") if self.keeps_space else bool(suffix) and token.endswith(suffix)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _direct(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunks(self, text: str) -> tuple[str, list[str]]:
        """The first chunk, encoded as it is, and the later ones, each with a space before it."""
        if not self.keeps_space:
            return "", text.replace("\n", " ").split(" ")
        parts = _SAFE.split(text) if _touches(text) else text.split(" ")
        return parts[0], parts[1:]

    def _alone(self, words: list[str], lead: str) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 256):
            out += [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast([lead + w for w in words[i : i + 256]], add_special_tokens=False)]
        return out

    def _in_lines(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters only are one pre-token each: encoded 64 to a line, which costs half as much, and cut apart."""
        out: dict[str, bytes] = {}
        lines = [words[i : i + 64] for i in range(0, len(words), 64)]
        for i in range(0, len(lines), 16):
            some = lines[i : i + 16]
            for line, got in zip(some, self.tokenizer.encode_batch_fast([self.lead + " ".join(x) for x in some], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, self.dtype)
                cut = np.flatnonzero(self.edge[ids[1:]]) + 1 if self.keeps_space else np.flatnonzero(self.edge[ids[:-1]]) + 1
                if len(cut) + 1 != len(line):  # a letter that the library takes for something else
                    out.update(zip(line, self._alone(line, self.lead), strict=True))
                    continue
                raw, w = ids.tobytes(), self.dtype.itemsize
                ends = [0, *(cut * w).tolist(), len(raw)]
                out.update((x, raw[a:b]) for x, a, b in zip(line, ends, ends[1:], strict=False))
        return out

    def _learn(self, words: set[str]) -> None:
        """Letters with marks behind them are two pre-tokens, so the letters are looked up on their own."""
        parts, odd = [], []
        for w in words:
            core = w.rstrip(MARKS)
            if core.isalpha():
                parts.append((w, core.lower() if not self.keeps_space and core.isascii() else core, w[len(core) :]))
            else:
                odd.append(w)
        new = sorted({c for _, c, _ in parts if c not in self.cache})
        cores = self._in_lines(new)
        for tail in {t for _, _, t in parts if t and t not in self.tails}:
            self.tails[tail] = self._alone([tail], "")[0]
        self.tails[""] = b""
        for w, c, t in parts:
            self.cache[w] = (cores[c] if c in cores else self.cache[c]) + self.tails[t]
        self.cache.update(zip(odd, self._alone(odd, self.lead), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 64):
            split = [self._chunks(t) for t in texts[i : i + 64]]
            new: set[str] = set()
            for _, rest in split:
                new.update(rest)
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache.clear()
            known = self.cache
            new = {w for w in new if w not in known and len(w) <= LONG_CHUNK}
            if new:
                self._learn(new)
            for first, rest in split:
                head = self._direct(first) if first else b""
                try:
                    out.append(head + b"".join(map(self.cache.__getitem__, rest)))
                except KeyError:  # chunks too long to keep
                    out.append(head + b"".join(self.cache[w] if len(w) <= LONG_CHUNK else self._direct(self.lead + w) for w in rest))
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


_zstd: dict[str, object] = {}


def compress(raw: bytes, width: int) -> bytes:
    """Ids of ``width`` bytes, each byte plane together, with zstd: about the entropy of the planes."""
    if "out" not in _zstd:
        import zstandard

        _zstd["out"] = zstandard.ZstdCompressor(level=1)
    return _zstd["out"].compress(np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes())


def decompress(packed: bytes, dtype: np.dtype) -> np.ndarray:
    if "in" not in _zstd:
        import zstandard

        _zstd["in"] = zstandard.ZstdDecompressor()
    planes = np.frombuffer(_zstd["in"].decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def token_rows(batches: Iterator, path: str, end_id: int, keep: tuple[str, ...]) -> Iterator:
    """Arrow batches with ``text`` and the columns ``keep`` -> those columns, uid, n_tokens and packed ids (end id added).

    Missing and empty texts have the end id alone. ``uid`` numbers the rows of a task after the task's own number.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    enc = encoder(path)
    end = np.array([end_id], enc.dtype).tobytes()
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        packed, n = [], []
        for raw in enc.encode(texts):
            raw += end
            n.append(len(raw) // enc.dtype.itemsize)
            packed.append(compress(raw, enc.dtype.itemsize))
        cols = {c: batch.column(c) for c in keep}
        cols |= {"uid": pa.array(range(uid, uid + len(n)), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(packed, pa.binary())}
        uid += len(n)
        yield pa.RecordBatch.from_pydict(cols)
