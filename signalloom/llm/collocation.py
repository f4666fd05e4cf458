"""Phrase collocations by contiguous pattern growth from projected occurrences.

Words of a language are numbered by a code book of the most frequent ones (a fixed size,
broadcast); rarer but still frequent words travel as hashes.  An occurrence is projected
as the code of its first word and of up to four that follow in its piece.  Occurrences are
dealt to tasks by prefix: a task holds all occurrences of its prefixes, sorted, and grows
each frequent prefix to the right depth first, each extension taking its range of the
pointers.  A word that cannot be in a frequent phrase ends a piece.

A prefix with more than ``most`` occurrences is no task's own: its extensions by one word
are prefixes instead (and theirs, down to whole contexts), and its count is the sum of what
their tasks report.  Which prefixes are so frequent is found level by level over all rows
beforehand, from the slices in which they stand out (some with half as many are taken too,
which changes no result); ``most`` rises with the corpus only so far that they stay below ``hot_prefixes``.
Equal contexts of a block travel once with their number, so copies weigh little.

A candidate of 2 to ``longest`` words is scored by its weakest cut, in whole numbers of up
to 38 digits.  A candidate is dropped where a phrase one word longer holds it and occurs as
often; a still longer one that does implies such a phrase.

Cases: null texts are empty; a null language is ``und``; repeated rows count each;
extra columns are ignored; a text of any length is cut into slices of occurrences, none is
lost at the edges; ties at the last rank go by phrase in byte order; empty tables give no
rows.  Words are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import U64, Words, blocks, mix, signed, words_of
from .workspace import Workspace, small_batches

APART = np.isin(np.arange(256), np.frombuffer(b" \t.,;:!?\n\x0b\x0c\r", np.uint8))
PIECE = APART & ~np.isin(np.arange(256), [32, 9])
SLICE = 1 << 21  # occurrences that are sorted at a time


@dataclass(frozen=True)
class CollocationConfig:
    """``least`` occurrences make a candidate; the rest bounds memory and changes no result."""

    least: int = 100
    longest: int = 5
    top: int = 2000
    book: int = 1 << 18
    most: int = 1 << 18
    hot_prefixes: int = 1 << 20
    bucket: int = 1 << 19


def piece_words(block: pa.RecordBatch) -> Iterator[tuple[str, Words, np.ndarray]]:
    """For each language of a block (``lang, text``): its words, and whether each begins a piece."""
    langs = block.column(0)
    for lang in langs.unique().to_pylist():
        w = words_of(block.column(1).filter(pc.equal(langs, lang)), APART)
        if len(w.start):
            breaks = np.concatenate([[0], np.cumsum(PIECE[w.raw])])[w.start]
            first = np.ones(len(w.start), bool)
            first[1:] = breaks[1:] != breaks[:-1]
            begins = w.bounds[:-1]
            first[begins[begins < len(first)]] = True
            yield lang, w, first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, hash, word, n`` of the words of each block, and the number of all words as the empty word."""
    for block in blocks(batches, "text", 1 << 22):
        for lang, w, _ in piece_words(block):
            key, at, n = np.unique(w.hash, return_index=True, return_counts=True)
            words = [w.raw[a:b].tobytes().decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
            columns = [[lang] * (len(key) + 1), np.append(signed(key), 0), [*words, ""], np.append(n, len(w.hash))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["lang", "hash", "word", "n"])


class Book:
    """Codes of the most frequent words from 1 on; 0 is a break, words beyond the book have codes of their block."""

    def __init__(self, hashes: np.ndarray, whole: bool):
        order = np.argsort(hashes)
        self.by_code, self.whole = np.concatenate([np.zeros(1, U64), hashes]), whole  # whole: no frequent word is missing
        self.sorted, self.code = hashes[order], (order + 1).astype(np.uint32)

    def encode(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the hashes of those beyond the book."""
        known, out = np.zeros(len(hashed), bool), np.zeros(len(hashed), np.uint32)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashed), len(self.sorted) - 1)
            known = self.sorted[at] == hashed
            out[known] = self.code[at[known]]
        if self.whole or known.all():
            return out, np.zeros(0, U64)
        rare, place = np.unique(hashed[~known], return_inverse=True)
        out[~known] = len(self.by_code) + place
        return out, rare


def _packed(table: np.ndarray) -> bytes:
    """32-bit numbers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(table.astype(np.uint32).reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(rows, -1)


def _encode(shared):
    """``lang, codes, rare``: the pieces of a block as codes with a 0 before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 22):
            for lang, w, first in piece_words(block):
                codes, rare = shared.value.encode(w.hash)
                codes = np.insert(codes, np.flatnonzero(first), 0)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([_packed(codes)], pa.binary()), pa.array([rare.tobytes()], pa.binary())], ["lang", "codes", "rare"])

    return run


def contexts(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """In slices: ``longest`` rows with the codes from each word on, 0 from the end of its piece; words at an end are left out."""
    for start in range(0, len(codes), SLICE):
        part = codes[start : start + SLICE]
        ahead = np.concatenate([codes[start : start + SLICE + longest], np.zeros(longest, codes.dtype)])
        at = np.flatnonzero((part != 0) & (ahead[1 : len(part) + 1] != 0))
        out = np.zeros((longest, len(at)), np.uint32)
        for k in range(longest):
            out[k] = ahead[at + k] if k == 0 else np.where(out[k - 1] != 0, ahead[at + k], 0)
        yield out


def extend(key: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The hash of a prefix with one more word."""
    return mix(key * U64(0x9E3779B97F4A7C15) + hashed + U64(1))


def _holds(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of ``key`` are among the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(key), bool)
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


def _encoded(batches: Iterator[pa.RecordBatch], book: Book) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Language and codes of each encoded block, and the hash of each code."""
    for batch in batches:
        for lang, codes, rare in zip(*(batch.column(k).to_pylist() for k in range(3))):
            yield lang, _unpacked(codes, 1)[0], np.concatenate([book.by_code, np.frombuffer(rare, U64)]) if rare else book.by_code


def _count_extensions(shared, hot: list[np.ndarray], longest: int, share: float):
    """``key, n`` of prefixes of ``len(hot) + 1`` words whose shorter prefixes are all hot, where they make up ``share`` of a slice's words.

    A prefix loses less than ``share`` of all words where it is rarer, so few rows travel
    and none of twice that many is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, hashes in _encoded(batches, shared.value):
            for rows in contexts(codes, longest):
                key = np.zeros(rows.shape[1], U64)
                for level, keys in enumerate(hot):
                    key = extend(key, hashes[rows[level]])
                    stay = _holds(keys, key) & (rows[level + 1] != 0)
                    key, rows = key[stay], rows[:, stay]
                found, n = np.unique(extend(key, hashes[rows[len(hot)]]), return_counts=True)
                often = n >= share * min(len(codes), SLICE)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found[often])), pa.array(n[often])], ["key", "n"])

    return run


def _deal(shared, hot: list[np.ndarray], longest: int, buckets: int):
    """``lang, bucket, data, rare``: distinct contexts of a block by the bucket of their own prefix.

    ``data`` holds a context's codes, the length of its own prefix (the shortest that is
    not hot) and how often it stands in the block.
    """

    def emit(lang: str, rows: np.ndarray, hashes: np.ndarray, size: int) -> pa.RecordBatch:
        own, deal, key = np.full(rows.shape[1], longest, np.uint32), np.zeros(rows.shape[1], U64), np.zeros(rows.shape[1], U64)
        todo = np.arange(rows.shape[1])
        for level in range(longest):
            key[todo] = extend(key[todo], hashes[rows[level, todo]])
            deal[todo] = key[todo]
            more = _holds(hot[level], key[todo]) if level < len(hot) else np.zeros(len(todo), bool)
            own[todo[~more]] = level + 1
            todo = todo[more]
        bucket = (mix(deal) % U64(buckets)).astype(np.int64)
        order = np.lexsort([*rows[::-1], bucket])
        rows, bucket, own = rows[:, order], bucket[order], own[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        at = np.flatnonzero(fresh)
        bucket = bucket[at]
        table = np.concatenate([rows[:, at], own[None, at], np.diff(np.append(at, len(order))).astype(np.uint32)[None]])
        edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        data, rare = [], []
        for a, b in zip(edge, [*edge[1:], len(bucket)]):
            part = table[:, a:b].copy()
            words = part[:longest]
            beyond = np.unique(words[words >= size])
            words[words >= size] = size + np.searchsorted(beyond, words[words >= size])
            data.append(_packed(part))
            rare.append(hashes[beyond].tobytes())
        columns = zip(([lang] * len(edge), bucket[edge], data, rare), (pa.string(), pa.int64(), pa.binary(), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["lang", "bucket", "data", "rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        size, held, many = len(book.by_code), {}, 0
        for lang, codes, hashes in _encoded(batches, book):
            if len(hashes) > size:  # words beyond the book are numbered within their block
                yield from (emit(lang, rows, hashes, size) for rows in contexts(codes, longest))
                continue
            held.setdefault(lang, []).append(codes)
            many += len(codes)
            if many >= SLICE:
                yield from (emit(name, rows, hashes, size) for name, parts in held.items() for rows in contexts(np.concatenate(parts), longest))
                held, many = {}, 0
        yield from (emit(name, rows, book.by_code, size) for name, parts in held.items() for rows in contexts(np.concatenate(parts), longest))

    return run


def grow(rows: np.ndarray, own: np.ndarray, many: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent phrases of sorted contexts as a row that begins with each, its number of words, its count.

    Phrases shorter than the contexts' own prefixes are counted in part here, so they are
    reported whatever their number.
    """
    longest, found = len(rows), []
    stack = [(0, 0, rows.shape[1])]
    while stack:
        depth, lo, hi = stack.pop()
        column = rows[depth, lo:hi]
        edge = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        count = np.add.reduceat(many[lo:hi], edge)
        go = (column[edge] != 0) & ((count >= least) | (own[lo + edge] > depth + 1))
        ends = np.append(edge[1:], hi - lo)
        for a, b, n in zip((lo + edge[go]).tolist(), (lo + ends[go]).tolist(), count[go].tolist()):
            if depth:
                found.append((a, depth + 1, n))
            if depth + 1 < longest:
                stack.append((depth + 1, a, b))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _grow_group(shared, c: CollocationConfig):
    def run(table: pa.Table) -> pa.Table:
        by_code = shared.value.by_code
        parts = [(_unpacked(d, c.longest + 2), np.frombuffer(r, U64)) for d, r in zip(table["data"].to_pylist(), table["rare"].to_pylist())]
        beyond = np.unique(np.concatenate([r for _, r in parts]))
        hashes = np.concatenate([by_code, beyond])
        for part, rare in parts:
            if len(rare):
                words = part[: c.longest]
                far = words >= len(by_code)
                words[far] = len(by_code) + np.searchsorted(beyond, rare[words[far] - len(by_code)])
        whole = np.concatenate([p for p, _ in parts], axis=1)
        whole = whole[:, np.lexsort(whole[: c.longest][::-1])]
        rows, own, many = whole[: c.longest], whole[-2], whole[-1].astype(np.int64)
        at, size, n = grow(rows, own, many, c.least)
        inside = np.arange(c.longest) < size[:, None]
        words = pa.array(signed(hashes[rows[:, at].T[inside]]))
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), words)
        lang = pa.array([table["lang"][0].as_py()] * len(at), pa.string())
        return pa.table([lang, lists, pa.array(n)], ["lang", "p", "f"])

    return run


def frequent_phrases(ws: Workspace, texts: DataFrame, c: CollocationConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``lang, text``: frequent words ``lang, hash, word, f``, phrases ``lang, p, f``, and totals ``lang, n``."""
    spark = texts.sparkSession
    counted = ws.save(texts.mapInArrow(_count_words, "lang string, hash long, word string, n long").groupBy("lang", "hash", "word").agg(F.sum("n").alias("f")).where(f"f >= {c.least} or word = ''"))
    words, totals = counted.where("word <> ''"), counted.where("word = ''").select("lang", F.col("f").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    by_hash = words.groupBy("hash").agg(F.sum("f").alias("f"))
    listed = by_hash.orderBy(F.desc("f"), "hash").limit(c.book).toArrow()  # at most ``book`` rows
    hashes = listed["hash"].to_numpy().astype(np.int64).view(U64)
    shared = spark.sparkContext.broadcast(Book(hashes, len(hashes) < c.book or by_hash.count() <= c.book))
    encoded = ws.save(texts.mapInArrow(_encode(shared), "lang string, codes binary, rare binary"))

    most, hot = max(c.most, total // c.hot_prefixes), []
    found = by_hash.where(F.col("f") > most).select(F.col("hash").alias("key")).toArrow()["key"].to_numpy().astype(np.int64).view(U64)
    found = extend(np.zeros(len(found), U64), found)
    while len(found) and len(hot) < c.longest - 1:
        hot.append(np.sort(found))
        if len(hot) < c.longest - 1:
            counts = encoded.mapInArrow(_count_extensions(shared, hot, c.longest, most / 4 / total), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
            found = counts.where(F.col("n") > most / 2).select("key").toArrow()["key"].to_numpy().astype(np.int64).view(U64)  # at most twice ``hot_prefixes`` rows
    dealt = encoded.mapInArrow(_deal(shared, hot, c.longest, max(1, -(-total // c.bucket))), "lang string, bucket long, data binary, rare binary")
    grown = dealt.groupBy("lang", "bucket").applyInArrow(_grow_group(shared, c), "lang string, p array<long>, f long")
    return words, ws.save(grown.groupBy("lang", "p").agg(F.sum("f").alias("f")).where(f"f >= {c.least}")), totals


def scored(words: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, p, a, l, r, n, score`` of the candidates that no longer phrase explains."""
    counts = phrases.select("lang", "p", "f").union(words.select("lang", F.array("hash"), "f"))
    cuts = phrases.select("lang", "p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("k")), "right": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    cuts = cuts.join(counts.select("lang", F.col("p").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("p").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "alrn"}
    score = F.expr(f"cast(1000 * {wide['a']} * {wide['n']} div ({wide['l']} * {wide['r']}) as long)")
    weakest = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "p", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where(F.size("p") > 2).select("lang", F.explode(F.array(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1))).alias("p"), "f")
    explained = inner.groupBy("lang", "p").agg(F.max("f").alias("longer"))
    return weakest.join(explained, ["lang", "p"], "left").where("longer is null or longer < a").select("lang", "p", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", config: CollocationConfig = CollocationConfig()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language."""
    c = config
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, phrases, totals = frequent_phrases(ws, texts, c)
    order = [F.desc("score"), F.desc("a")]
    best = ws.save(scored(words, phrases, totals).withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= c.top))
    spelt = best.select("lang", "p", F.posexplode("p").alias("pos", "hash")).join(words.select("lang", "hash", "word"), ["lang", "hash"])
    spelt = spelt.groupBy("lang", "p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = best.join(spelt, ["lang", "p"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= c.top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
