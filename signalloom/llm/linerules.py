"""Quality rules by the frequency of lines across the documents of a host.

A line is normalised (A-Z lower-cased, runs of white space made one) and hashed to 64
bits.  The distinct documents of a host that hold it are counted; documents with equal
lines count once, so copies do not make their own lines frequent.  Lines in more documents
than the host's limit are removed, and a document that loses more than ``depleted`` of its
words is rejected.  Repetition and shape of each single text are counted in the same pass.

Frequent lines reach the documents that hold them without a join on a frequent line: the
``heavy`` most frequent ones (a fixed number) are broadcast, and every other one is joined,
where no line is in more than a ``heavy``-th of all lines.

Cases: null texts count as empty and fail the rules; a null host is the empty host; every
row is judged by itself, so repeated ids and rows each yield a row; extra columns are
ignored by ``judge`` and kept by ``clean``; a text of any length is one block; lines without
a word are never counted or removed; of tied lines at the edge of ``heavy`` either may be
broadcast, the result is the same; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import AS_IS, U64, blocks, grams, mix, signed, words_of
from .workspace import Workspace, small_batches

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
NEWLINE = np.arange(256) == 10
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "row long, host string, digest long, " + ", ".join(f"{c} long" for c in STATS) + ", lines array<struct<line:long,start:int,end:int,words:int>>"


@dataclass(frozen=True)
class LineRules:
    """A line is frequent beyond ``min_docs`` documents of a host and beyond ``share`` of them."""

    min_docs: int = 20
    share: float = 0.01
    depleted: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50
    heavy: int = 100_000


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _later(key: np.ndarray) -> np.ndarray:
    """Where a key has occurred before."""
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def _repeated(key: np.ndarray) -> np.ndarray:
    _, group, many = np.unique(key, return_inverse=True, return_counts=True)
    return many[group] > 1


def line_facts(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """Statistics of each text, its hash, and its lines that have a word (with ``doc``)."""
    plain, folded, lines = words_of(column, fold=AS_IS), words_of(column), words_of(column, NEWLINE, AS_IS)
    n = np.diff(plain.bounds)
    document = np.repeat(np.arange(len(n)), n)
    follows = np.concatenate([[0], np.cumsum(lines.raw & 0xC0 != 0x80)])  # code points before each byte

    # words that stand in a window of three that occurs again in the same text
    window = grams(plain.hash, 3)
    inside = np.flatnonzero(document[2:] == document[: max(len(document) - 2, 0)])
    again = inside[_repeated(mix(window[inside] + mix(document[inside].astype(U64) + U64(1))))]
    covered = np.zeros(len(document), bool)
    for k in range(3):
        covered[again + k] = True

    owner = np.repeat(np.arange(len(n)), np.diff(lines.bounds))
    first, last = np.searchsorted(plain.start, lines.start), np.searchsorted(plain.start, lines.end)
    some = np.flatnonzero(last > first)
    first, last, owner = first[some], last[some], owner[some]
    same = _later(mix(lines.hash[some] + mix(owner.astype(U64) + U64(3))))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])

    # the words of a line in order, whatever stands between them
    line = np.repeat(np.arange(len(some)), last - first)
    place = (np.arange(len(line)) - np.repeat(first - first[:1].sum(), last - first)) if len(line) else line
    mixed = folded.hash[first[0] : last[-1]] if len(some) else folded.hash[:0]
    weighed = mix(mixed ^ mix(place.astype(U64) + U64(11)))
    key = np.add.reduceat(weighed, first - first[0]) if len(some) else weighed
    key = mix(key + (last - first).astype(U64))

    texts = np.zeros(len(n), U64)
    at = np.arange(len(lines.hash)) - np.repeat(lines.bounds[:-1], np.diff(lines.bounds))
    own = mix(lines.hash ^ mix(at.astype(U64) * U64(2) + U64(5)))
    np.add.at(texts, np.repeat(np.arange(len(n)), np.diff(lines.bounds)), own)
    stats = {
        "n_words": n,
        "word_chars": _sums(follows[plain.end] - follows[plain.start], plain.bounds),
        "n_symbols": _sums(SYMBOLS[lines.raw], _starts(column, len(lines.raw))),
        "n_dup_lines": _sums(same, bounds),
        "n_repeat_words": _sums(covered, plain.bounds),
    }
    origin = follows[_starts(column, len(lines.raw))[:-1]][owner]
    found = {"doc": owner, "line": key, "start": follows[lines.start[some]] - origin, "end": follows[lines.end[some]] - origin, "words": last - first}
    return stats, mix(texts + np.diff(lines.bounds).astype(U64)), found


def _starts(column: pa.Array, size: int) -> np.ndarray:
    """Byte offsets of the texts in the block."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets - offsets[0] if size else np.zeros(len(column) + 1, np.int64)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        stats, digest, found = line_facts(block.column(2))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(found["doc"], minlength=block.num_rows))]).astype(np.int32)
        entry = pa.StructArray.from_arrays([pa.array(signed(found["line"])), *(pa.array(found[c], pa.int32()) for c in ("start", "end", "words"))], ["line", "start", "end", "words"])
        arrays = [block.column(0), block.column(1), pa.array(signed(digest)), *(pa.array(stats[c], pa.int64()) for c in STATS), pa.ListArray.from_arrays(bounds, entry)]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "host", "digest", *STATS, "lines"])


def frequent_lines(facts: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``host, line, docs`` of the lines above their host's limit."""
    texts = facts.groupBy("host", "digest").agg(F.first("lines.line").alias("lines"))  # equal texts have equal lines
    counted = texts.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > rules.min_docs)
    hosts = facts.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return counted.join(hosts, "host").where(F.col("docs") > rules.share * F.col("host_docs")).select("host", "line", "docs")


def _matches(facts: DataFrame, frequent: DataFrame, heavy: int) -> DataFrame:
    """``row`` and its lines that are frequent at its host."""
    lines = facts.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    if heavy:
        hot = frequent.orderBy(F.desc("docs"), "host", "line").limit(heavy)
        found = lines.join(F.broadcast(hot.select("host", "line")), ["host", "line"], "left_semi")
        if frequent.count() <= heavy:
            return found
        edge = hot.agg(F.min("docs")).first()[0]
        cold = frequent.where(F.col("docs") <= edge).join(F.broadcast(hot.where(F.col("docs") == edge).select("host", "line")), ["host", "line"], "left_anti")
        return found.union(lines.join(cold.select("host", "line"), ["host", "line"], "left_semi"))
    return lines.join(frequent.select("host", "line"), ["host", "line"], "left_semi")


def judge(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id``, the statistics, ``removed`` spans of frequent lines, ``n_removed_lines``, ``n_removed_words``, ``base_failed, kept`` for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "rules")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out, block in zip(_facts(iter([batch])), blocks(iter([batch]), "text")):
                yield out.append_column("doc_id", block.column(3))

    facts = ws.save(texts.mapInArrow(run, f"{SCHEMA}, doc_id {kind}"))
    frequent = ws.save(frequent_lines(facts, rules))
    spans = _matches(facts, frequent, rules.heavy).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.count("*").alias("n_lines"), F.sum("words").alias("gone"))
    out = facts.drop("lines").join(spans, "row", "left")
    gone = F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    return out.select(
        "row", "doc_id", *STATS, F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("removed"), F.coalesce("n_lines", F.lit(0)).alias("n_removed_lines"), gone.alias("n_removed_words"),
        failed.alias("base_failed"), (~failed & (gone <= rules.depleted * F.col("n_words"))).alias("kept"),
    )


def clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their frequent lines (and the line ends behind them) cut out."""
    ws = Workspace(docs.sparkSession, "ruled")
    keyed = ws.save(docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("key")))
    judged = judge(keyed.select("key", F.col(f"whole.{text_col}").alias("text"), F.col(f"whole.{host_col}").alias("host")), rules, "key", "text", "host")
    joined = keyed.join(judged.where("kept").select(F.col("doc_id").alias("key"), "removed"), "key")
    piece = lambda i: F.substring(f"whole.{text_col}", F.when(i > 0, F.col("removed")[i - 1]["end"] + 2).otherwise(1), F.when(i < F.size("removed"), F.col("removed")[i]["start"] - F.when(i > 0, F.col("removed")[i - 1]["end"] + 1).otherwise(0)).otherwise(F.lit(2**30)))
    text = F.when(F.size("removed") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size("removed")), piece), "")).otherwise(F.col(f"whole.{text_col}"))
    return joined.withColumn("cut", text).select(*(F.col("cut").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns))
