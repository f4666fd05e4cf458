"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every word has a tree whose leaves hold the rank of the pair that starts at that symbol;
the root is the leftmost lowest-rank merge.  A merge changes three leaves and their
paths.  The distinct words of a block are encoded together, one merge of every word per
numpy step; long words take the same steps alone.  Words already met by a worker are
remembered up to a bound.

Cases: null texts count as empty and give no tokens; a null id is returned with its row;
texts of any length are encoded whole; special-token strings in a text become their ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks
from .workspace import small_batches

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
LONG = 256
SHIFT = 26
NONE = np.int64(1) << 62
REMEMBERED = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (chr(256 + k) for k in range(256))
    return [chr(b) if b in own else next(other) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a word-end BPE file in the format of the tokenizers library."""

    def __init__(self, content: str):
        whole = json.loads(content)
        model = whole["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.piece = {i: p for p, i in vocab.items()} | {i: p for p, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.by_key = dict(zip(key.tolist(), range(len(key))))
        self.known: dict[str, tuple[int, bytes, str]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it cannot merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def encode_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some words of at most ``LONG`` bytes."""
        size = np.array([len(w) for w in words])
        n, wide = len(words), 1 << max(1, int(size.max() - 1).bit_length())
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(n, wide)
        here = np.arange(wide)
        sym = np.where(here < size[:, None], self.inner[raw], -1)
        sym[np.arange(n), size - 1] = self.final[raw[np.arange(n), size - 1]]
        right = np.where(here + 1 < size[:, None], here + 1, -1)
        left = np.where(here < size[:, None], here - 1, -1)
        tree = np.full((n, 2 * wide), NONE)
        after = np.concatenate([sym[:, 1:], np.full((n, 1), -1)], axis=1)
        rank = self.rank(sym, after)
        tree[:, wide:] = np.where(rank >= 0, (rank << SHIFT) | here, NONE)
        for level in range(wide.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            i = best & ((1 << SHIFT) - 1)
            j = right[live, i]
            k = right[live, j]
            sym[live, i] = self.made[best >> SHIFT]
            sym[live, j] = -1
            right[live, i] = k
            has = k >= 0
            left[live[has], k[has]] = i[has]
            h = left[live, i]
            before = h >= 0
            self._put(tree, wide, live, j, np.full(len(live), -1))
            self._put(tree, wide, live, i, np.where(has, self.rank(sym[live, i], sym[live, np.maximum(k, 0)]), -1))
            self._put(tree, wide, live[before], h[before], self.rank(sym[live[before], h[before]], sym[live[before], i[before]]))
            live = live[tree[live, 1] < NONE]
        return [row[row >= 0] for row in sym]

    @staticmethod
    def _put(tree: np.ndarray, wide: int, rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
        at = leaf + wide
        tree[rows, at] = np.where(rank >= 0, (rank << SHIFT) | leaf, NONE)
        for _ in range(wide.bit_length() - 1):
            at >>= 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length: the same tree, on plain lists."""
        n = len(word)
        wide = 1 << (n - 1).bit_length()
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.final[word[-1]])
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        none, made, get = int(NONE), self.made, self.by_key.get

        def leaf(i: int, j: int) -> int:
            rank = get((sym[i] << 32) | sym[j]) if i >= 0 and j >= 0 else None
            return none if rank is None else (rank << SHIFT) | i

        tree = [none] * (2 * wide)
        for i in range(n - 1):
            tree[wide + i] = leaf(i, i + 1)
        for x in range(wide - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(i: int, value: int) -> None:
            x = wide + i
            tree[x] = value
            while x > 1:
                x >>= 1
                value = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == value:
                    return
                tree[x] = value

        while tree[1] < none:
            i = tree[1] & ((1 << SHIFT) - 1)
            j = right[i]
            k = right[j]
            sym[i], sym[j], right[i] = int(made[tree[1] >> SHIFT]), -1, k
            if k >= 0:
                left[k] = i
            put(j, none)
            put(i, leaf(i, k))
            if left[i] >= 0:
                put(left[i], leaf(left[i], i))
        return np.array([s for s in sym if s >= 0], np.int64)

    def pieces(self, text: str) -> list[str]:
        """Words of a text after normalisation, special tokens among them."""
        if self.split and "<|" in text:
            return [p for k, part in enumerate(self.split.split(text)) for p in ([part] if k % 2 else self.pieces_of(part))]
        return self.pieces_of(text)

    @staticmethod
    def pieces_of(text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return PIECES.findall(text)

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for w in (w for w in self.special if w in words):
            self.known[w] = (1, np.array([self.special[w]], "<u4").tobytes(), w)
        sized = sorted(((w, w.encode()) for w in new if w not in self.special), key=lambda x: len(x[1]))
        at = 0
        while at < len(sized):
            width = 1 << max(1, (len(sized[at][1]) - 1).bit_length())
            part = [sized[at]]
            if width > LONG:
                ids = [self.encode_long(sized[at][1])]
            else:
                part = [x for x in sized[at : at + max(64, 65536 // width)] if len(x[1]) <= width]
                ids = self.encode_many([b for _, b in part])
            at += len(part)
            for (w, _), got in zip(part, ids):
                self.known[w] = (len(got), got.astype("<u4").tobytes(), self.decode(got.tolist()))

    def decode(self, ids: list[int]) -> str:
        """The library's decoding of a file without a decoder: pieces joined by spaces."""
        return " ".join(map(self.piece.__getitem__, ids))


_MODELS: dict[int, Bpe] = {}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for each row; ``ids`` are packed little-endian uint32."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())  # a vocabulary file: under 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(content.value)
        if key not in _MODELS:
            _MODELS[key] = Bpe(content.value)
        model = _MODELS[key]
        for block in blocks(batches, "text"):
            texts = [model.pieces(t or "") for t in block.column(1).to_pylist()]
            model.learn(set().union(*texts))
            count, ids, decoded = [], [], []
            for words in texts:
                found = [*map(model.known.__getitem__, words)]
                count.append(sum([f[0] for f in found]))
                ids.append(b"".join([f[1] for f in found]))
                decoded.append(" ".join([f[2] for f in found]))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string")
