"""LM scoring by a weighted backoff automaton over smoothed word n-grams.

States are contexts (the last words of a text, a text starts behind an end), arcs are
n-grams seen in training and every state has a failure arc to its shorter context.
Smoothing is hierarchical Dirichlet: p(w | s) = (c(s w) + mass * p(w | shorter)) /
(c(s) + mass), over an add-one unigram base, which sums to one exactly; an arc carries
log10 p(w | s), a failure arc log10(mass / (c(s) + mass)).

The model grows with the corpus and is never held whole.  Texts are packed into blocks
of about half a million tokens, written once in buckets of the block's number.  Orders
are counted one after the other.  A block sends each of its distinct n-grams once, with
its training count, to the shard of the n-gram's hash; the shard adds up the counts of
all blocks and answers every block, also whether another block holds the n-gram.  An n-gram
whose first or last n - 1 words no other block holds is in no other block, so its count is
known at once and it is not sent.  A frequent n-gram costs one entry a block, and a block holds just the part of the
automaton that its texts can reach.  Words are keyed by 64-bit hashes, longer n-grams by
56 bits; keys travel as sorted differences and all arrays as compressed byte planes, a
fifth of what rows of an n-gram each would take.  Shards hold a bounded number of tokens,
so messages are as many as blocks times shards: they are worth their size up to some
hundred gigabytes of text, beyond which ``block_tokens`` has to grow.

Cases: null and empty texts consist of their end alone; rows with a null id train and
are scored like others; repeated rows count each; with an empty training set every
probability is that of the unigram base.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, blocks, mix, words_of
from .workspace import Workspace, small_batches

END = U64(0x3C6EF372FE94F82B)


@dataclass(frozen=True)
class LmConfig:
    order: int = 3
    mass: float = 200.0
    block_tokens: int = 1 << 19
    shards_per_partition: int = 2
    shard_tokens: int = 1 << 22


BLOCK = "block long, n long, ids array<{id}>, train array<boolean>, bounds binary, tokens binary, vocab binary"


def squeeze(x: np.ndarray) -> bytes:
    """An array of integers as compressed byte planes, its length first."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unsqueeze(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first from zero."""
    return np.diff(x, prepend=np.zeros(1, x.dtype))


def _pack(c: LmConfig):
    """Texts to blocks: token numbers into the sorted hashes of the block's words."""

    def row(block: int, ids: list, train: list, hashes: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.ListArray.from_arrays([0, len(train)], pa.concat_arrays(ids)), pa.array([train], pa.list_(pa.bool_())),
            pa.array([bounds.tobytes()], pa.binary()), pa.array([squeeze(tokens.astype(np.uint32))], pa.binary()), pa.array([squeeze(steps(vocab))], pa.binary()),
        ], ["block", "n", "ids", "train", "bounds", "tokens", "vocab"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, 0
        ids, train, hashes, sizes = [], [], [], []
        for x in blocks(batches, "text"):
            w = words_of(x.column(1))
            n = np.diff(w.bounds)
            ids.append(x.column(0)), train.extend(x.column(2).to_pylist()), sizes.extend((n + 1).tolist())
            hashes.append(np.insert(w.hash, w.bounds[1:], END))
            held += len(hashes[-1])
            if held >= c.block_tokens:
                yield row(block, ids, train, hashes, sizes)
                block, held = block + 1, 0
                ids, train, hashes, sizes = [], [], [], []
        if sizes:
            yield row(block, ids, train, hashes, sizes)

    return run


class Reach:
    """The n-grams of one block: for each order the distinct keys, each token's n-gram and
    the distinct n-grams' first and last n - 1 words."""

    def __init__(self, bounds: bytes, tokens: bytes, vocab: bytes, train: list[bool], order: int):
        self.bounds, self.tokens = np.frombuffer(bounds, np.int64), unsqueeze(tokens, np.uint32).astype(np.int64)
        words = np.cumsum(unsqueeze(vocab, U64), dtype=U64)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        self.training = np.repeat(np.array(train, bool), np.diff(self.bounds))
        self.keys, self.at = [words], [self.tokens]
        self.head, self.tail = [None], [None]
        end = int(np.searchsorted(words, END))
        for n in range(2, order + 1):
            # The n-gram of a token is its context's (n - 1)-gram, one token back, and the token.
            before = np.concatenate([[0], self.at[-1][:-1]]) if n > 2 else np.concatenate([[end], self.tokens[:-1]])
            if n == 2:
                before = np.where(self.place == 0, end, before)
            whole = np.flatnonzero(self.place >= n - 2)
            distinct, first, own = np.unique(before[whole] * len(words) + self.tokens[whole], return_index=True, return_inverse=True)
            at = np.full(len(self.tokens), -1)
            at[whole] = own
            self.head.append(distinct // len(words))
            self.tail.append(self.at[-1][whole[first]])
            self.keys.append(mix(self.keys[-1][self.head[-1]] * U64(0x9E3779B97F4A7C15) + mix(words[distinct % len(words)] + U64(n))))
            self.at.append(at)

    def counts(self, k: int) -> np.ndarray:
        own = self.at[k][self.training & (self.at[k] >= 0)]
        return np.bincount(own, minlength=len(self.keys[k]))

    def open(self, k: int, shared: list[np.ndarray]) -> np.ndarray:
        """The n-grams of a level that other blocks may hold, sorted by key."""
        order = np.argsort(self.keys[k])
        return order[(shared[k - 1][self.head[k]] & shared[k - 1][self.tail[k]])[order]] if k else order

    def dealt(self, k: int, order: np.ndarray, shards: int) -> np.ndarray:
        """The bounds of each shard, a range of keys, in sorted keys."""
        shard = (self.keys[k][order] >> U64(48)).astype(np.int64) * shards >> 16
        return np.searchsorted(shard, np.arange(shards + 1))


def _known(reach: Reach, answers: list, levels: int, shards: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The counts of all blocks for the n-grams of one, and which of them other blocks hold."""
    found = {(a["level"], a["shard"]): a["totals"] for a in answers or ()}
    totals, shared = [], []
    for k in range(levels):
        order, told = reach.open(k, shared), [unsqueeze(found[k, s], U64) for s in range(shards) if (k, s) in found]
        both = np.concatenate(told) if told else np.zeros(0, U64)
        total, more = reach.counts(k).astype(np.int64), np.zeros(len(reach.keys[k]), bool)
        total[order], more[order] = (both >> U64(1)).astype(np.int64), (both & U64(1)).astype(bool)
        totals.append(total), shared.append(more)
    return totals, shared


PARTS = ("train", "bounds", "tokens", "vocab", "answers")


def _ask(level: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in range(x.num_rows):
                train, bounds, tokens, vocab, answers = (x.column(k)[r].as_py() for k in PARTS)
                reach = Reach(bounds, tokens, vocab, train, level + 1)
                order = reach.open(level, _known(reach, answers, level, shards)[1])
                cut = reach.dealt(level, order, shards)
                keys, own = reach.keys[level][order], reach.counts(level)[order].astype(np.uint32)
                keys = keys if level == 0 else keys >> U64(8)
                rows = [(s, squeeze(steps(keys[a:b])), squeeze(own[a:b])) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if a < b]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.column("block")[r].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
                ], ["block", "shard", "keys", "counts"])

    return run


def _answer(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add up the counts of each n-gram over all blocks; rows come sorted by shard.

        The first row of a shard also tells its training tokens and distinct n-grams.
        """
        held: list[tuple] = []

        def told() -> pa.RecordBatch:
            each = [np.cumsum(unsqueeze(r[2], U64), dtype=U64) for r in held]
            distinct, at = np.unique(np.concatenate(each), return_inverse=True)
            total = np.bincount(at, np.concatenate([unsqueeze(r[3], np.uint32) for r in held]), len(distinct)).astype(U64)
            shared = (np.bincount(at, minlength=len(distinct)) > 1).astype(U64)
            cut = np.cumsum([0] + [len(x) for x in each])
            out, rest = (total << U64(1) | shared)[at], [0] * (len(held) - 1)
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in held], pa.int64()), pa.array([level] * len(held), pa.int32()), pa.array([r[1] for r in held], pa.int32()),
                pa.array([squeeze(out[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()), pa.array([int(total.sum()), *rest], pa.int64()), pa.array([int((total > 0).sum()), *rest], pa.int64()),
            ], ["block", "level", "shard", "totals", "n", "kinds"])

        for x in batches:
            for r in zip(*(x.column(k).to_pylist() for k in ("block", "shard", "keys", "counts"))):
                if held and held[0][1] != r[1]:
                    yield told()
                    held = []
                held.append(r)
        if held:
            yield told()

    return run


class Automaton:
    """States, arcs and failure arcs that the texts of one block can reach."""

    def __init__(self, reach: Reach, totals: list[np.ndarray], size: int, kinds: int, mass: float):
        self.reach, self.order = reach, len(totals)
        at = reach.at
        seen = [np.where(at[k] >= 0, totals[k][np.maximum(at[k], 0)] if len(totals[k]) else 0, 0) for k in range(self.order)]
        self.known = seen[0] > 0
        p = (seen[0] + 1.0) / (size + kinds + 1)
        self.base = np.log10(p)
        self.arc, self.has, self.fail, self.state = [self.base], [np.ones(len(p), bool)], [None], [None]
        ends = totals[0][int(np.searchsorted(reach.keys[0], END))] if len(p) else 0
        for k in range(1, self.order):
            context = np.concatenate([[0], seen[k - 1][:-1]])
            context = np.where(reach.place == (k - 1), ends if k == 1 else context, context)
            context = np.where(reach.place >= k - 1, context, 0)
            p = (seen[k] + mass * p) / (context + mass)
            self.arc.append(np.log10(p))
            self.has.append(seen[k] > 0)
            self.fail.append(np.log10(mass / (context + mass)))
            self.state.append(context > 0)

    def traverse(self) -> np.ndarray:
        """Log10 probability of each text: all texts of the block step left to right together."""
        bounds = self.reach.bounds
        size = np.diff(bounds)
        longest = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[longest], -np.arange(int(size.max(initial=0))), "left")
        total, depth, first = np.zeros(len(size)), np.ones(len(size), np.int64), bounds[:-1][longest]
        depth = np.minimum(depth, self.order - 1)
        for t, n in enumerate(alive.tolist()):
            pos = first[:n] + t
            step, open_ = np.zeros(n), np.ones(n, bool)
            d, reached = depth[:n].copy(), np.zeros(n, np.int64)
            for k in range(self.order - 1, 0, -1):
                here = open_ & (d >= k)
                taken = here & self.has[k][pos]
                step[taken] += self.arc[k][pos[taken]]
                reached[taken] = k
                missed = here & ~taken
                step[missed] += np.where(self.state[k][pos[missed]], self.fail[k][pos[missed]], 0.0)
                open_ &= ~taken
            step[open_] += self.arc[0][pos[open_]]
            total[:n] += step
            depth[:n] = np.minimum(reached + 1, self.order - 1)
        out = np.empty(len(size))
        out[longest] = total
        return out


def _score(c: LmConfig, shards: int, size: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in range(x.num_rows):
                train, bounds, tokens, vocab, answers = (x.column(k)[r].as_py() for k in PARTS)
                reach = Reach(bounds, tokens, vocab, train, c.order)
                auto = Automaton(reach, _known(reach, answers, c.order, shards)[0], size, kinds, c.mass)
                cut = reach.bounds
                sums = lambda v: np.add.reduceat(v, cut[:-1])
                yield pa.RecordBatch.from_arrays([
                    x.column("ids")[r].values, pa.array([not t for t in train]), pa.array(np.diff(cut)), pa.array(sums(auto.known.astype(np.int64))),
                    pa.array(np.full(len(train), size, np.int64)), pa.array(sums(auto.base)), pa.array(auto.traverse()),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", config: LmConfig = LmConfig()) -> DataFrame:
    """Scores of all rows by a model of those where ``train`` holds.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    c, spark = config, docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "lm")
    kind = dict(docs.dtypes)[id_col]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    packed = ws.save_by(texts.mapInArrow(_pack(c), BLOCK.format(id=kind)), "block", partitions)
    shards = max(partitions * c.shards_per_partition, math.ceil((packed.agg(F.sum("n")).first()[0] or 0) / c.shard_tokens))

    answers = None
    for level in range(c.order):
        asked = _joined(packed, answers).mapInArrow(_ask(level, shards), "block long, shard int, keys binary, counts binary")
        asked = asked.repartition(partitions, "shard").sortWithinPartitions("shard")
        told = ws.save(asked.mapInArrow(_answer(level), "block long, level int, shard int, totals binary, n long, kinds long"))
        if level == 0:
            total = told.agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).first()
        told = told.select("block", "level", "shard", "totals")
        answers = told if answers is None else answers.union(told)
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _joined(packed, answers).mapInArrow(_score(c, shards, total["n"] or 0, total["kinds"] or 0), out)


def _joined(packed: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Blocks with the answers to them so far; a block's answers are about a byte for each of its n-grams."""
    if answers is None:
        return packed.withColumn("answers", F.lit(None).cast("array<struct<level:int,shard:int,totals:binary>>"))
    return packed.join(answers.groupBy("block").agg(F.collect_list(F.struct("level", "shard", "totals")).alias("answers")), "block", "left")
