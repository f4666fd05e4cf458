"""Filter interaction audit by the multilinear extension of a removal game.

Every document has a mask of the filters that it fails.  The counts of masks in a part
give the polynomial that tells how many documents a set of filters removes:
``f(x) = sum of count[m] * (1 - product over i in m of (1 - x_i))``.  Expanded, the
monomial of the set T has the coefficient ``(-1)^(|T|+1)`` times the documents that fail
all of T.  At a corner of the cube ``f`` is what that set of filters removes; the
integral of a filter's partial derivative along the diagonal is its Shapley value.  Both
are exact rationals; times the number of orders they are whole.

Masks are aggregated before anything else moves, so a part costs at most 2**filters rows,
whatever its size; the orders of a part are written out by the task that holds its counts.

Cases: a null text counts as empty, a null part as the empty string; a null id has no
label and neither is nor has an earlier copy; of several labels of one id the highest
counts; rows that repeat an id and a text are counted each, none is a copy of the other;
extra columns are ignored; no rows give no parts.  Texts of any length are handled as
whole strings inside one row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

MOST_FILTERS = 7  # 5040 orders of seven rows in a part
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficient of each set of filters, from the number of documents with each mask."""
    above = list(counts)  # documents that fail all filters of a set
    for bit in (1 << k for k in range(len(counts).bit_length() - 1)):
        for m in range(len(counts)):
            if not m & bit:
                above[m] += above[m | bit]
    return [0] + [-above[t] if t.bit_count() % 2 == 0 else above[t] for t in range(1, len(counts))]


def corners(poly: list[int]) -> list[int]:
    """The polynomial at every corner: what each set of filters removes."""
    value = list(poly)
    for bit in (1 << k for k in range(len(poly).bit_length() - 1)):
        for s in range(len(poly)):
            if s & bit:
                value[s] += value[s ^ bit]
    return value


def shapley(poly: list[int], k: int) -> Fraction:
    """The partial derivative by filter ``k``, integrated along the diagonal from 0 to 1."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(poly) if t >> k & 1), Fraction(0))


def audit_rows(letters: str, counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """``(order, step, *COUNTS)`` of every order and step of one part."""
    n, total, scale = len(letters), sum(counts), math.factorial(len(letters))
    poly = removal_polynomial(counts)
    gone, lost, bad = corners(poly), corners(removal_polynomial(good)), corners(removal_polynomial(toxic))
    every = (1 << n) - 1
    value = [int(scale * shapley(poly, k)) for k in range(n)]
    out = []
    for order in itertools.permutations(range(n)):
        name, before = "".join(letters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            here = gone[after] - gone[before]
            out.append((name, step, total - gone[after], here, gone[1 << k] - here, gone[every] - gone[every ^ 1 << k], lost[after] - lost[before], bad[after] - bad[before], value[k]))
            before = after
    return out


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """All orders of the filters from ``part, mask, n, good, toxic`` (rows may repeat a part and mask)."""
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be ordered, not {len(letters)}")
    summed = masks.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most one cell a mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, good, toxic = ([0] * (1 << len(letters)) for _ in range(3))
                for c in cells:
                    counts[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                rows = audit_rows(letters, counts, good, toxic)
                kinds = [pa.string(), pa.int32()] + [pa.int64()] * len(COUNTS)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def mask_of(failures: list[Column]) -> Column:
    """One bit for each failure condition; an unknown one counts as passed."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) * F.lit(1 << k) for k, f in enumerate(failures)), F.lit(0)).cast("int")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Conditions on one text: few words, few distinct words, capitals, marks of markup."""
    n = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n,
        "C": 100 * capitals > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, digest`` and more, ids and digests counted together) with ``copy``: a smaller id has the same digest.

    The first id of each digest is joined back by both, so the join's keys are spread
    however many copies a text has.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    return rows.join(first, ["doc_id", "digest"], "left").withColumn("copy", F.col("first").isNull() & F.col("doc_id").isNotNull()).drop("first")


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic`` of five filters; the fifth, E, is an equal text under a smaller id."""
    ws = Workspace(docs.sparkSession, "masks")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    own = mask_of(list(text_failures(F.col("text"), F.col("words")).values())).alias("own")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    rows = ws.save(base.select("doc_id", "part", own, digest).groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n")))
    masks = later_copies(rows).withColumn("mask", F.col("own") + F.when(F.col("copy"), 16).otherwise(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counted = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    named, unnamed = counted.where("doc_id is not null").join(known, "doc_id", "left"), counted.where("doc_id is null")
    good = [F.when(F.col(c) == 1, F.col("n")).otherwise(0).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    return named.select("part", "mask", "n", *good).union(unnamed.select("part", "mask", "n", F.lit(0).cast("long"), F.lit(0).cast("long")))


def audit_documents(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the filters A to E, and step."""
    return audit(document_masks(docs, labels, **columns), "ABCDE")
