"""Substring dedup by hashing normalised lines or paragraphs.

A unit is a line (or a paragraph).  Digests are grouped over all rows with partial
aggregation; the earliest occurrence by (doc_id, row, offset) is kept, rows with a null
id come last, and every later occurrence of a line is removed.  Copied passages also
begin or end inside a line, so the sentences of a line are hashed as well: where repeated
lines and sentences that stand next to each other have ``passage_words`` or more
together, the sentences go too.  A single repeated sentence in a line of its own text
stays.  With ``unit="sentence"`` sentences are the units themselves.  A stop before a
small letter or a digit (3.14, example.com) ends no sentence.  Offsets are characters of
the original text.

Cases: null texts count as empty and come back empty; every row has its own key, so a
repeated row loses what the one before it holds, also where the id is repeated or null
(rows of one id stand in the order of their texts' hashes); extra columns are ignored;
a long text is a block of its own, whose lines are hashed one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks
from .workspace import Workspace, small_batches

UNITS = {"sentence": re.compile(r"(?:[^.!?。！？\n]|[.!?]++(?=[a-z0-9ß-öø-ÿά-ώа-џ]))*+[.!?。！？\n]*"), "line": re.compile(r"[^\n]*\n*"), "paragraph": re.compile(r"(?:[^\n]|\n(?!\s*\n))*\s*")}
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
SCHEMA = "doc_id long, tie long, row long, h1 long, h2 long, start int, end int, words int, whole boolean"


def normalise(unit: str) -> str:
    """Case, spacing and outer punctuation do not distinguish units."""
    return " ".join(unit.lower().split()).rstrip(".!?。！？")


def words_in(plain: str) -> int:
    """Runs between spaces; each letter counts in scripts that are written without."""
    return plain.count(" ") + 1 if plain.isascii() else max(plain.count(" ") + 1, len(UNSPACED.findall(plain)))


def _units(kind: str, passages: bool):
    cut, inner = UNITS[kind], UNITS["sentence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows: list[tuple] = []
            digest: list[bytes] = []

            def add(doc: int, at: int, unit: str, plain: str, whole: bool) -> None:
                rows.append((doc, at, at + len(unit), words_in(plain), whole))
                digest.append(xxhash.xxh3_128_digest(plain))

            for doc, text in enumerate(block.column(3).to_pylist()):
                at = 0
                for unit in cut.findall(text):
                    plain = normalise(unit)
                    if plain:
                        add(doc, at, unit, plain, True)
                        parts = inner.findall(unit) if passages else ()
                        if len(parts) > 2:  # the last match is empty
                            inside = at
                            for part in parts:
                                own = normalise(part)
                                if own:
                                    add(doc, inside, part, own, False)
                                inside += len(part)
                    at += len(unit)
            two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            keys = [block.column(k).take(pa.array([r[0] for r in rows], pa.int64())) for k in range(3)]
            rest = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32()] * 3 + [pa.bool_()], 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(two[:, 0]), pa.array(two[:, 1]), *rest], ["doc_id", "tie", "row", "h1", "h2", "start", "end", "words", "whole"])

    return run


def removable(text: str, spans: list[tuple[int, int, int, bool]], min_words: int, passage_words: int) -> list[tuple[int, int, int]]:
    """Runs ``(start, end, words)`` to remove, from repeated units ``(start, end, words, whole)``."""
    runs: list[list] = []
    covered = 0
    for a, b, n, whole in sorted(spans, key=lambda s: (s[0], not s[3])):
        if not whole and b <= covered:
            continue  # a sentence of a line that is repeated as a whole
        covered = max(covered, b) if whole else covered
        if not runs or text[runs[-1][-1][1] : a].strip(" \t\r\n\x0b\x0c.!?。！？"):
            runs.append([])
        runs[-1].append((a, b, n, whole))
    out = []
    for run in runs:
        if sum(r[2] for r in run) >= passage_words:
            parts = [run]
        else:
            parts, before = [], False
            for r in run:
                if r[3]:
                    (parts[-1] if before else parts.append([]) or parts[-1]).append(r)
                before = r[3]
            parts = [p for p in parts if sum(r[2] for r in p) >= min_words]
        out += [(p[0][0], p[-1][1], sum(r[2] for r in p)) for p in parts]
    return out


def _cut(min_words: int, passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            clean, removed, count = [], [], []
            for text, spans in zip(block.column(1).to_pylist(), block.column(2).to_pylist()):
                runs = removable(text, [tuple(s.values()) for s in spans or ()], min_words, passage_words)
                parts, at = [], 0
                for a, b, _ in runs:
                    parts.append(text[at:a])
                    at = b
                clean.append("".join([*parts, text[at:]]))
                removed.append([{"start": a, "end": b, "words": n} for a, b, n in runs])
                count.append(sum(n for *_, n in runs))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(clean, pa.string()), pa.array(removed, kind), pa.array(count, pa.int64())], ["doc_id", "text", "removed", "n_removed_words"])

    return run


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1, passage_words: int = 20) -> DataFrame:
    """``doc_id, text, removed(start, end, words), n_removed_words`` for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "units")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = ws.save(texts.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    order = [F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64("text").alias("tie"), "row", "text"]
    units = ws.save(texts.select(*order).mapInArrow(_units(unit, unit != "sentence"), SCHEMA))
    first = units.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tie", "row", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = ws.save(first.select("h1", "h2", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")))
    later = units.join(first, ["h1", "h2"]).where("row <> first_row or start <> first_start")
    spans = ws.save(later.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "words", "whole"))).alias("spans")))
    ws.drop(units)
    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(_cut(min_words, passage_words if unit != "sentence" else min_words), "doc_id long, text string, removed array<struct<start:int,end:int,words:int>>, n_removed_words long")
