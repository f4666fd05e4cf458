"""Benchmark decontamination by CGK embedding, bit-sampling LSH and edit verification.

Words are the symbols (A-Z lower-cased, ASCII punctuation apart).  An item leaks into a
text if some window of it is within ``max_edit`` times the item's words of edits.

A CGK walk reads a sequence with a head that, at each step, moves on or stays by a random
bit of the step and the symbol below it, so that edits become Hamming distance.  A window
starts at every word of a text.  The walks of all its windows take their steps together;
once two of them stand on one word they stay together, so they are followed as one.
Items take the same walks.  Bit sampling hashes the symbols seen at a few random steps of
a walk; a window that agrees with an item on all steps of one sample is a candidate.
Samples are drawn for classes of item length (powers of two), from the steps that a walk
needs for about that many words, so they look at windows of the items' own size.  A long
item is walked from every ``STRIDE``-th of its words as well, so edits that crowd in one
place leave the others to be met.  Many samples of several walks together reach the target
recall (measured in the tests against all windows).  Candidates are dropped where fewer words of the item stand around the
place than edits allow, which loses none, and the others are verified by exact edit
distance over all windows around it.

The items are handled in groups of bounded size: a group travels to the tasks as bare
word hashes, the tasks build its index, and the texts are passed once for each group.

Cases: null or empty texts and items match nothing; items too short for an edit must
occur exactly; a text that repeats an item gives its best place, the first of several with
equally many edits; a long text is walked in slices with overlap; repeated rows are each
searched and yield one row per id and item; rows and items with a null id are searched too
and share one id; ids may be of any type; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, blocks, mix, words_of
from .workspace import Workspace, small_batches

APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SURE = 3  # from 2**SURE words on an item is looked at where two samples agree within its edits
LONGEST = 48  # steps of a walk at most, which are about half as many words
STRIDE = 16  # a walk begins at every so many words of a long item, and at each quarter or half of a short one


@dataclass(frozen=True)
class DecontaminationConfig:
    """``samples`` of ``symbols`` steps each from every one of ``walks`` walks; fewer serve items of ``2**SURE`` words and more."""

    max_edit: float = 0.2
    walks: int = 4
    samples: int = 10
    long_samples: int = 7
    symbols: int = 3
    group_bytes: int = 8 << 20


def edits(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a window of ``region``; its start and end."""
    n = len(region)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for k, symbol in enumerate(item, 1):
        fresh, origin = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        fresh[0], origin[0] = k, 0
        match = row[:-1] + (region != symbol)
        skip = row[1:] + 1
        fresh[1:] = np.minimum(match, skip)
        origin[1:] = np.where(match <= skip, start[:-1], start[1:])
        reach = fresh - np.arange(n + 1)
        low = np.minimum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == low, np.arange(n + 1), 0))
        fresh, origin = low + np.arange(n + 1), origin[source]
        row, start = fresh, origin
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


def moves(symbols: np.ndarray, walk: int, half: int) -> np.ndarray:
    """64 random bits of each symbol, one a step; the head stays on 0, which ends a text."""
    bits = mix(symbols ^ mix(np.array([977 * walk + half + 1], U64)))
    return np.where(symbols == 0, U64(0), bits)


def walked(symbols: np.ndarray, walk: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """CGK walks of rows of symbols (0 behind the end): symbols and places at each step."""
    rows = np.arange(len(symbols))
    at = np.zeros(len(symbols), np.int64)
    seen, place = np.empty((len(symbols), steps), U64), np.empty((len(symbols), steps), np.int64)
    padded = np.concatenate([symbols, np.zeros((len(symbols), 1), U64)], axis=1)
    for t in range(steps):
        if t % 64 == 0:
            bits = moves(padded.ravel(), walk, t // 64).reshape(padded.shape)
        seen[:, t], place[:, t] = padded[rows, at], at
        at += (bits[rows, at] >> U64(t % 64) & U64(1)).astype(np.int64)
    return seen, place


def span_of(level: int) -> int:
    """Steps from which items of 2**level to 2**(level + 1) - 1 words are sampled."""
    return min(LONGEST, max(1, int(1.2 * (1 << level))))


def samples_of(walk: int, level: int, size: int, count: int) -> list[np.ndarray]:
    """Sets of ``size`` steps in rising order, drawn afresh for each walk and level."""
    rng, span = np.random.default_rng([walk, level, size]), span_of(level)
    first = span // 4 if level >= SURE else 0  # by then most walks have met
    return [first + np.sort(rng.choice(span - first, min(size, span - first), replace=False)) for _ in range(count)]


def blended(symbol: np.ndarray, place: int) -> np.ndarray:
    """What the symbol in some place of a sample adds to the sample's hash."""
    return symbol * (mix(np.array([place + 99], U64)) | U64(1))


class Matcher:
    """The index of one group of items: hashes of sampled steps to items and their places."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, bounds: np.ndarray, c: DecontaminationConfig):
        size = np.diff(bounds)
        keep = np.flatnonzero(size)
        self.c, self.ids, self.size = c, ids[keep], size[keep]
        self.words = [words[a:b] for a, b in zip(bounds[keep].tolist(), bounds[keep + 1].tolist())]
        self.allowed = np.floor(c.max_edit * self.size + 1e-9).astype(np.int64)
        owner = np.repeat(np.arange(len(keep)), self.size)
        own = np.concatenate(self.words) if self.words else np.zeros(0, U64)
        self.own = np.unique(mix(own + U64(1)) ^ mix(owner.astype(U64) + U64(7)))
        self.reach = int((self.size + 2 * self.allowed).max(initial=0))
        level = np.frexp(self.size.astype(float))[1] - 1
        strides = [max(STRIDE // 4, min(STRIDE, 1 << max(n.bit_length() - 2, 0))) for n in self.size.tolist()]
        begins = [np.arange(0, max(n - d + 1, 1), d) for n, d in zip(self.size.tolist(), strides)]
        self.samples: list[list[tuple]] = []
        self.steps = 0
        for walk in range(c.walks):
            sets = []
            for lv in np.unique(level).tolist():
                rows = np.flatnonzero(level == lv)
                span = span_of(lv)
                self.steps = max(self.steps, span)
                taken = [begins[k][(begins[k] == 0) | (begins[k] // strides[k] % 2 == walk % 2)] for k in rows.tolist()]  # later places in every other walk
                rows, begin = np.repeat(rows, [len(b) for b in taken]), np.concatenate(taken)
                wide = np.zeros((len(rows), span), U64)
                for r, (k, at) in enumerate(zip(rows.tolist(), begin.tolist())):
                    part = self.words[k][at : at + span]
                    wide[r, : len(part)] = part
                seen, place = walked(wide, walk, span)
                place += begin[:, None]
                for steps in samples_of(walk, lv, c.symbols, c.samples if lv < SURE else c.long_samples):
                    good = (seen[:, steps] != 0).all(axis=1)
                    key = np.zeros(len(rows), U64)
                    for n, t in enumerate(steps.tolist()):
                        key = key + blended(seen[:, t], n)
                    order = np.argsort(key[good], kind="stable")
                    bits = np.zeros(1 << max(16, int(8 * len(rows)).bit_length()), bool)
                    bits[(key[good] >> U64(65 - len(bits).bit_length())).astype(np.int64)] = True
                    sets.append((steps.tolist(), key[good][order], rows[good][order], place[good, steps[0]][order], bits))
            self.samples.append(sets)

    def hits(self, symbols: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, a place where a head stood, and the start of the window that fits it."""
        for walk, sets in enumerate(self.samples):
            wanted = {t for s in sets for t in s[0]}
            at, bits = np.arange(starts), moves(symbols, walk, 0)
            seen: dict[int, np.ndarray] = {}
            place: dict[int, np.ndarray] = {}
            merged: list[tuple[int, np.ndarray]] = []  # step of a merger, the merged row of each row before it
            for t in range(self.steps):
                if t and t % 64 == 0:
                    bits = moves(symbols, walk, t // 64)
                if t in (2, 5, 10, 18, 28, 40, 56, 76):
                    fresh = np.concatenate([[True], at[1:] != at[:-1]])
                    merged.append((t, np.cumsum(fresh) - 1))
                    at = at[fresh]
                if t in wanted:
                    seen[t], place[t] = symbols[at], at
                if len(at):
                    at = at + (bits[at] >> U64(t % 64) & U64(1)).astype(np.int64)
            part: dict[tuple[int, int], np.ndarray] = {}
            for steps, key, item, offset, mask in sets:
                first, row, hashed = steps[0], None, None
                for n, t in enumerate(steps):
                    if (t, n) not in part:
                        part[t, n] = blended(seen[t], n)
                    for _, to in (m for m in merged if n and steps[n - 1] < m[0] <= t):
                        row = to if row is None else to[row]
                    more = part[t, n] if row is None else part[t, n][row]
                    hashed = more if hashed is None else hashed + more
                near = np.flatnonzero(mask[(hashed >> U64(65 - len(mask).bit_length())).astype(np.int64)])
                lo, hi = np.searchsorted(key, hashed[near], "left"), np.searchsorted(key, hashed[near], "right")
                many = hi - lo
                if many.any():
                    flat = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    head = np.repeat(place[first][near], many)
                    yield item[flat], head, head - offset[flat]

    def candidates(self, hashed: np.ndarray, bounds: np.ndarray, limit: int = 1 << 18, longest: int = 1 << 15) -> Iterator[tuple[int, int, int, int]]:
        """``(document, item, first, end)`` of regions of words that may hold an item."""
        symbols = np.insert(hashed, bounds[1:], U64(0))  # each text is followed by a 0
        document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds) + 1)
        found = []
        wide = len(symbols) + 2 * self.reach
        for a in range(0, len(symbols), limit):
            b = min(a + limit, len(symbols))
            part = [(document[head + a] * len(self.ids) + item) * wide + (start + a + self.reach) for item, head, start in self.hits(symbols[a : b + self.steps + 1], b - a)]
            if part:
                found.append(self.plausible(self.agreed(np.sort(np.concatenate(part)), wide), symbols, wide))
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if not len(key):
            return
        pair, start = key // wide, key % wide - self.reach
        edge = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (np.diff(start) > (self.size + 2 * self.allowed)[pair[1:] % len(self.ids)])]))
        for x, y in zip(edge.tolist(), [*(edge[1:] - 1).tolist(), len(key) - 1]):
            d, k = divmod(int(pair[x]), len(self.ids))
            most, size = int(self.allowed[k]), int(self.size[k])
            first, end = max(int(start[x]) - most - d, int(bounds[d])), min(int(start[y]) + size + most - d, int(bounds[d + 1]))
            for at in range(first, max(end - size - 2 * most, first + 1), longest):
                yield d, k, at, min(at + longest + size + 2 * most, end)

    def agreed(self, key: np.ndarray, wide: int) -> np.ndarray:
        """Distinct candidates, without those of longer items that a single sample has met."""
        item = key // wide % len(self.ids)
        near = np.diff(key) <= self.allowed[item[1:]]
        alone = ~(np.concatenate([[False], near]) | np.concatenate([near, [False]]))
        return np.unique(key[~(alone & (self.size[item] >= 1 << SURE))])

    def plausible(self, key: np.ndarray, symbols: np.ndarray, wide: int) -> np.ndarray:
        """Candidates around which enough words of the item stand, in any order."""
        item, start = key // wide % len(self.ids), key % wide - self.reach
        level = np.frexp(self.size.astype(float))[1][item]
        out = []
        for lv in np.unique(level).tolist():
            every = np.flatnonzero(level == lv)
            reach = int((self.size + 2 * self.allowed)[item[every]].max())
            step = max(1, (1 << 20) // reach)
            for rows in (every[a : a + step] for a in range(0, len(every), step)):
                k = item[rows]
                at = (start[rows] - self.allowed[k])[:, None] + np.arange(reach)
                inside = (at >= 0) & (at < len(symbols)) & (np.arange(reach) < (self.size + 2 * self.allowed)[k][:, None])
                own = mix(symbols[np.clip(at, 0, len(symbols) - 1)] + U64(1)) ^ mix(k.astype(U64) + U64(7))[:, None]
                where = np.minimum(np.searchsorted(self.own, own), len(self.own) - 1)
                enough = ((self.own[where] == own) & inside).sum(axis=1) >= (self.size - self.allowed)[k]
                out.append(key[rows[enough]])
        return np.concatenate(out) if out else key

    def search(self, hashed: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(document, item id, edits, first word, end word)`` of a block of documents."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, a, b in self.candidates(hashed, bounds) if self.words else ():
            if best.get((d, k), (1,))[0] == 0:
                continue
            if np.isin(self.words[k], hashed[a:b]).sum() < self.size[k] - self.allowed[k]:
                continue
            n, start, end = edits(self.words[k], hashed[a:b])
            if n <= self.allowed[k]:
                found = n, a + start - int(bounds[d]), a + end - int(bounds[d])
                best[d, k] = min(best.get((d, k), found), found)
        return [(d, int(self.ids[k]), *v) for (d, k), v in best.items()]


_MATCHERS: dict[str, Matcher] = {}


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """``doc_id, item_id, edits, first_word, end_word`` for each text and item that leaks into it."""
    c, spark = config, docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "leaks")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, math.ceil(2 * size / c.group_bytes))
    kinds = [texts.schema["doc_id"].dataType, items.schema["item_id"].dataType]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, edits int, first_word int, end_word int"
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow().combine_chunks()  # a group: bounded by group_bytes
        w = words_of(_one(rows["text"]), APART)
        shared = spark.sparkContext.broadcast((_one(rows["item_id"]), w.hash, w.bounds))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            ids, hashed, bounds = shared.value
            if name not in _MATCHERS:
                _MATCHERS.clear()
                _MATCHERS[name] = Matcher(np.arange(len(ids)), hashed, bounds, c)
            matcher = _MATCHERS[name]
            for block in blocks(batches, "text"):
                w = words_of(block.column(1), APART)
                found = matcher.search(w.hash, w.bounds)
                at = [pa.array([r[k] for r in found], pa.int64()) for k in range(2)]
                yield pa.RecordBatch.from_arrays([block.column(0).take(at[0]), ids.take(at[1]), *(pa.array([r[k] for r in found], pa.int32()) for k in (2, 3, 4))], ["doc_id", "item_id", "edits", "first_word", "end_word"])

        found = texts.mapInArrow(run, schema)
        if parts > 1:
            found = ws.save(found)
            shared.unpersist()
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word", "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.edits", "b.first_word", "b.end_word")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
