"""MinHash near-dedup with sequential Bayesian verification.

Rows with equal shingle sets are one class, a node of its own number, whatever their ids
and however often they repeat.  Classes that share a band of their signature are candidates; signature batches of a candidate
are compared one after the other and the pair is pruned as soon as the posterior
probability that its similarity reaches the threshold falls below ``miss``.  Survivors
are confirmed on the full shingle sets.

Groups of near copies are never expanded into all pairs.  First each member of a bucket
is compared with the bucket's most central member.  Buckets that then still hold several
components are compared tile by tile inside tasks, which carry the full sets: pairs of
different components that survive the signature batches are confirmed, likeliest first,
and a tile emits just the links that join components.  Pairs within a component need no
further look, as they cannot change the result, so no candidate is dropped.

Cases: null or empty texts have no shingles and link with nothing; texts of fewer words
than a shingle count as one shingle; repeated rows are each returned; texts of one id
belong together, each with its own shingle count; rows with a null id are returned with
their shingle count, a null component and kept, and link with nothing; ids of any type
that has an order; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import U64, blocks, grams, mix, words_of
from .workspace import Workspace, small_batches


@dataclass(frozen=True)
class MinHashConfig:
    """Linked: 100 * intersection >= percent * union of the shingle sets.

    ``bands`` of ``rows`` miss a pair at similarity 0.8 with a probability of 5e-6.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    hashes: int = 256
    batch: int = 32
    miss: float = 1e-6
    tile: int = 512


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words_of(column)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        out.append(np.unique(grams(w.hash[a:b], min(words, b - a))) if b > a else np.zeros(0, U64))
    return out


def _signature(s: np.ndarray, mult: np.ndarray, salt: np.ndarray) -> np.ndarray:
    best = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), 1024):
        np.minimum(best, (((s[None, k : k + 1024] ^ salt[:, None]) * mult[:, None]) >> U64(32)).astype(np.uint32).min(axis=1), out=best)
    return best


def _sign(c: MinHashConfig, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, c.hashes + 1, dtype=U64))
        mult = mix(salt + U64(77)) | U64(1)
        keys = mix(np.arange(1, c.rows + 1, dtype=U64) + U64(991)) | U64(1)
        seeds = mix(np.arange(1, c.bands + 1, dtype=U64) + U64(4242))
        for block in blocks(batches, text_col):
            n, digest, sig, bands = [], [], [], []
            for s in shingle_sets(block.column(1), c.words):
                n.append(len(s))
                if not len(s):
                    digest.append(None), sig.append(None), bands.append(None)
                    continue
                m = _signature(s, mult, salt)
                banded = m[: c.bands * c.rows].reshape(c.bands, c.rows).astype(U64)
                digest.append(np.array([mix(s).sum(), mix(s ^ U64(0x5851F42D4C957F2D)).sum(), len(s)], U64).tobytes())
                sig.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append(mix((banded * keys).sum(axis=1) + seeds).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "t", "n_shingles", "digest", "sig", "bands"])

    return run


def least_matches(c: MinHashConfig) -> list[int]:
    """After each batch, the fewest equal hashes with which a pair is kept.

    Signatures hold 8 bits of a hash, so two of them agree with p = J + (1 - J) / 256.
    With a uniform prior P(p >= x | m of n) is P(Binomial(n + 1, x) <= m).
    """
    x = c.percent / 100
    x += (1 - x) / 256
    out = []
    for n in range(c.batch, c.hashes + 1, c.batch):
        tail, m = 0.0, -1
        while tail < c.miss:
            m += 1
            tail += comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
        out.append(m)
    return out


def survive(c: MinHashConfig, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two signature matrices survive all batches, and their matches."""
    live, hits = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        part = slice(k * c.batch, (k + 1) * c.batch)
        hits[live] += (a[live, part] == b[live, part]).sum(axis=1, dtype=np.int32)
        live = live[hits[live] >= m]
    return live, hits


def _prune(c: MinHashConfig):
    least = least_matches(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                one, two = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, c.hashes) for k in (2, 3))
                live, _ = survive(c, one, two, least)
                yield x.take(pa.array(live)).select([0, 1])

    return run


def linked(c: MinHashConfig, p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    at = np.searchsorted(p, q)
    both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
    return 100 * both >= c.percent * (len(p) + len(q) - both)


def _exact(c: MinHashConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [linked(c, np.frombuffer(one.as_buffer(), U64), np.frombuffer(two.as_buffer(), U64)) for one, two in zip(x.column(2), x.column(3))]
            yield x.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _tile(c: MinHashConfig):
    """Links that join components within each tile of a bucket.

    Rows come sorted by tile.  A pair belongs to the first band that it shares, so no
    other bucket looks at it again.
    """
    least = least_matches(c)

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        side, rep, comp, n = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6))
        first, second = rows[0][1], rows[0][2]
        sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), -1)
        band = np.array([r[8] for r in rows], np.int64)
        here = int(np.flatnonzero(band[0] == rows[0][0])[0])
        found = []
        for k in range(len(rows)):
            ok = (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= c.percent * np.maximum(n, n[k]))
            ok &= rep > rep[k] if first == second else (side == second) & (side[k] == first)
            near = np.flatnonzero(ok)
            if here:
                near = near[~(band[near, :here] == band[k, :here]).any(axis=1)]
            if len(near):
                live, hits = survive(c, sig[near], np.broadcast_to(sig[k], (len(near), sig.shape[1])), least)
                found += zip(hits[live].tolist(), [k] * len(live), near[live].tolist())
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        for _, i, j in sorted(found, reverse=True):
            p, q = top(int(comp[i])), top(int(comp[j]))
            if p != q and linked(c, np.frombuffer(rows[i][9], U64), np.frombuffer(rows[j][9], U64)):
                root[p] = q
                yield int(rep[i]), int(rep[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "t1", "t2", "side", "rep", "comp", "n_shingles", "sig", "bands", "shingles"]
        rows: list[tuple] = []
        out: list[tuple[int, int]] = []
        for r in chain((r for x in batches for r in zip(*(x.column(k).to_pylist() for k in names))), [None]):
            if rows and (r is None or r[:3] != rows[0][:3]):
                if len(rows) > 1:
                    out += pairs(rows)
                rows = []
                if len(out) > 10_000 or r is None:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                    out = []
            if r is not None:
                rows.append(r)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    c, spark = config, docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "minhash")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    kind = dict(texts.dtypes)["doc_id"]
    signed = ws.save(texts.mapInArrow(_sign(c, "doc_id", "text"), f"doc_id {kind}, t long, n_shingles long, digest binary, sig binary, bands array<long>"))
    whole = signed.where("doc_id is not null and digest is not null")
    # Shingle sets, signatures and bands of a class are the same in all its rows.
    classes = whole.groupBy("digest").agg(F.min(F.struct("doc_id", "t")).alias("least"), *(F.first(x).alias(x) for x in ("n_shingles", "sig", "bands")))
    reps = ws.save(classes.withColumn("rep", F.monotonically_increasing_id()))
    classes = reps.select("digest", "rep", F.col("least.doc_id").alias("least"))

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = ws.save(keyed.join(sizes, "key"))
    central = member.groupBy("rep").agg(F.sum("size").alias("weight"))
    bare, member = member, ws.save(member.join(central, "rep"))
    ws.drop(bare)
    leader = member.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("top")).select("key", (-F.col("top.r")).alias("leader"))
    star = member.join(leader, "key").where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()

    # The set of a class is made from its least row; where that row repeats, once.
    ids = member.select("rep").distinct().join(reps.select("rep", "least.doc_id", "least.t"), "rep")
    own = texts.join(ids.hint("merge"), ["doc_id", "t"]).groupBy("doc_id", "t", "rep").agg(F.first("text").alias("text"))
    sets = ws.save(_sets(own.select("rep", "text"), c))

    def both(pairs: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
        for k in ("a", "b"):
            pairs = pairs.join(table.select(F.col("rep").alias(k), *(F.col(x).alias(f"{x}_{k}") for x in cols)), k)
        return pairs

    def confirmed(pairs: DataFrame) -> DataFrame:
        return both(pairs, sets, "shingles").select("a", "b", "shingles_a", "shingles_b").mapInArrow(_exact(c), "a long, b long")

    near = both(star, reps, "n_shingles", "sig").where(100 * F.least("n_shingles_a", "n_shingles_b") >= c.percent * F.greatest("n_shingles_a", "n_shingles_b"))
    pruned = ws.save(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(c), "a long, b long"))
    links = ws.save(confirmed(pruned))
    labels = components(ws, links)
    comp = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    comp = ws.save(comp)
    mixed = comp.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("size").alias("s")).where("x <> y and s > 2").select("key")
    open_rows = comp.join(mixed, "key").withColumn("tiles", F.ceil(F.col("size") / c.tile)).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    dealt = open_rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"t1": F.least("side", "o"), "t2": F.greatest("side", "o")})
    dealt = dealt.join(reps, "rep").join(sets, "rep").select("key", "t1", "t2", "side", "rep", "comp", "n_shingles", "sig", "bands", "shingles")
    spread = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    more = ws.save(spread.mapInArrow(_tile(c), "a long, b long"))
    if not more.isEmpty():
        labels = components(ws, links.union(more))
    ws.drop(sets)
    numbered = ws.save(signed.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left"))
    # Texts of one id belong together: a link between each of its classes and the first.
    own = numbered.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same = ws.save(numbered.join(own, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct())
    if not same.isEmpty():
        labels = components(ws, links.union(more).union(same))
    grouped = classes.select("rep", "least").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_rep = ws.save(grouped.select("rep", "component").join(least, "component").select("rep", "component_id"))
    out = numbered.join(by_rep, "rep", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sets(texts: DataFrame, c: MinHashConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([s.tobytes() for s in shingle_sets(block.column(1), c.words)], pa.binary())], ["rep", "shingles"])

    return texts.mapInArrow(run, "rep long, shingles binary")
