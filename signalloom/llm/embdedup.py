"""Embedding near-dedup by sorted projection passes.

Equal vectors of one label are one class first.  In each pass the classes are ordered by
label and by the bits of random hyperplanes, most significant first; every vector is
compared with its ``window`` neighbours in that order at least, and links of all passes are
united.  The order is cut into blocks of equal size with an overlap, so a label or code
of any size spreads over many tasks; inside a block all are compared with all.

Signs are taken of unit vectors less the mean of their label, so vectors that lie in a
cone are divided too.  Each label has its own number of passes: from its size, the angle
that a pair at the threshold has around that mean, and from a trial.  In the trial, vectors
of a bounded sample get made-up partners at the threshold; how often a pass brings the two
within a window, by the ranks of their codes among all codes of the label, tells how many
passes reach the wanted recall, however the label's vectors are grouped.

A pass emits a star of each group that is linked in a block, which has the links' components.  Vectors that are linked directly
are in the same component, so the links of each vector are then counted over its whole
component, in tiles of exact comparisons: dense groups beyond any window are whole and
no pair is ever written.

A class has a number of its own.  What links are counted between are entries: a class with
the ids that stand in it alone, or an id with all its vectors where they are in several
classes; so an id is one vector to others, however often it repeats.

Cases: rows with a null label, vectors that are null, empty, zero or hold null or
non-finite components link with nothing and are their own component; vectors of
different length never link; repeated ids are one node, each row is returned and none
links with its own id; the vectors of one id are compared in one task; rows with a null
id are returned with a null component and kept; ids of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .workspace import Workspace, small_batches


@dataclass(frozen=True)
class EmbeddingConfig:
    cosine: float = 0.93
    window: int = 512
    recall: float = 0.999
    bits: int = 62
    block: int = 1024
    tile: int = 1024
    least_passes: int = 12
    trial: int = 256
    trial_passes: int = 4


def passes_for(n: int, spread: float, c: EmbeddingConfig) -> int:
    """Passes after which a pair at the threshold has met with the wanted probability.

    A pair meets when its codes share enough leading bits that a window spans their
    bucket: log2(n / window) of them, each shared with probability 1 - angle / pi.  The
    angle is taken around the mean, from which unit vectors have a mean square distance
    ``spread``; below 1 - cosine an average pair is linked and the plain angle serves.
    This holds for one cone a label; the trial sees to labels of several groups.
    """
    depth = max(0.0, math.log2(max(n, 1) / c.window))
    cosine = 1 - (1 - c.cosine) / spread if spread > 1 - c.cosine else c.cosine
    meet = (1 - math.acos(cosine) / math.pi) ** depth
    return max(c.least_passes, math.ceil(math.log(1 - c.recall) / math.log(1 - min(meet, 0.999))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.array(column.flatten(), dtype=np.float64).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the unit vectors of each label in a batch."""
    for b in batches:
        dims = np.array(b.column("dims"))
        for d in np.unique(dims).tolist():
            part = b.filter(pa.array(dims == d))
            code = part.column("label").dictionary_encode()
            total = np.zeros((len(code.dictionary), d))
            np.add.at(total, np.array(code.indices), _units(_matrix(part.column("embedding"), d)))
            n = np.bincount(np.array(code.indices), minlength=len(total))
            yield pa.RecordBatch.from_arrays([code.dictionary, pa.array(np.full(len(total), d, np.int32)), pa.array([*total], pa.list_(pa.float64())), pa.array(n.astype(np.int64))], ["label", "dims", "total", "n"])


def _codes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            dims, passes = np.array(b.column("dims")), np.array(b.column("passes"))
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = _units(_matrix(part.column("embedding"), d)) - _matrix(part.column("mean"), d)
                own = passes[dims == d]
                for p in range(own.max()):
                    if (d, p) not in planes:
                        planes[d, p] = _planes(d, p, bits)
                    at = np.flatnonzero(own > p)
                    code = ((x[at] @ planes[d, p] > 0) * weight).sum(axis=1)
                    take = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), take.column("label"), take.column("dims"), pa.array(code), take.column("rep")], ["pass", "label", "dims", "code", "rep"])

    return run


def _planes(d: int, p: int, bits: int) -> np.ndarray:
    return np.random.default_rng([1000 + d, p]).standard_normal((d, bits))


def met_share(sample: np.ndarray, mean: np.ndarray, cuts: list[np.ndarray], n: int, c: EmbeddingConfig) -> float:
    """How often one pass brings a vector and a partner at the threshold into one window.

    ``cuts`` are evenly spaced codes of the trial passes, which give ranks of other codes.
    Vectors that are linked with more than a window of others, going by the sample, are
    chained to those by any order and left out.
    """
    crowd = (sample @ sample.T >= c.cosine).sum(axis=1) - 1
    sample = sample[crowd < max(1, len(sample) * c.window / n)]
    if not len(sample):
        return 1.0
    rng = np.random.default_rng(7)
    step = rng.standard_normal(sample.shape)
    step = _units(step - (step * sample).sum(axis=1, keepdims=True) * sample)
    partner = c.cosine * sample + math.sqrt(1 - c.cosine**2) * step
    weight = np.int64(1) << np.arange(c.bits - 1, -1, -1, dtype=np.int64)
    met = []
    for p, cut in enumerate(cuts):
        planes = _planes(len(mean), p, c.bits)
        place = [np.searchsorted(cut, (((x - mean) @ planes > 0) * weight).sum(axis=1)) for x in (sample, partner)]
        met.append(np.abs(place[0] - place[1]) * n / (len(cut) + 1) <= c.window)
    return float(np.mean(met))


def _passes(c: EmbeddingConfig):
    """The number of passes of each label from its size, mean, trial sample and trial codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for n, total, mean, sample, cuts in zip(*(b.column(k).to_pylist() for k in ("n", "total", "mean", "sample", "cuts"))):
                m = np.array(mean)
                least = max(passes_for(total, 0.0, c), passes_for(n, 1 - float(m @ m), c))
                if n > c.window and 1 - float(m @ m) > 1 - c.cosine:  # else a window holds the label, or an average pair is linked
                    share = max(met_share(_units(np.array(sample, np.float64)), m, [np.array(x["cut"]) for x in sorted(cuts, key=lambda x: x["pass"])], n, c), 1 / c.trial)
                    least = max(least, math.ceil(math.log(1 - c.recall) / math.log(1 - min(share, 0.999))))
                found.append(least)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("dims"), b.column("mean"), pa.array(found, pa.int32())], ["label", "dims", "mean", "passes"])

    return run


def _coded(ws: Workspace, classes: DataFrame, c: EmbeddingConfig) -> tuple[DataFrame, int]:
    """``pass, label, dims, code, rep`` of all passes, and the number of rows."""
    kind = dict(classes.dtypes)["label"]
    zone, fields = ["label", "dims"], f"pass int, label {kind}, dims int, code long, rep long"
    total = classes.select(*zone, "embedding").mapInArrow(_sums, f"label {kind}, dims int, total array<double>, n long")
    mean = total.select(*zone, "n", F.posexplode("total").alias("at", "x")).groupBy(*zone, "at").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    mean = mean.groupBy(*zone).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("mean"), F.max("n").alias("n"))
    mean = ws.save(mean.select(*zone, "mean", "n"))
    tried = classes.select(*zone, "embedding", "rep").join(mean, zone).withColumn("passes", F.lit(c.trial_passes))
    tried = tried.select(*zone, "embedding", "mean", "rep", "passes").mapInArrow(_codes(c.bits), fields)
    cuts = tried.groupBy(*zone, "pass").agg(F.percentile_approx("code", [k / 2000 for k in range(1, 2000)], 10_000).alias("cut"))
    cuts = cuts.groupBy(*zone).agg(F.collect_list(F.struct("pass", "cut")).alias("cuts"))  # a few numbers a label
    first = F.row_number().over(Window.partitionBy(*zone).orderBy(F.xxhash64("rep")))
    sample = classes.select(*zone, "embedding", "rep").withColumn("r", first).where(F.col("r") <= c.trial).groupBy(*zone).agg(F.collect_list("embedding").alias("sample"))
    known = mean.withColumn("total", F.lit(classes.count())).join(cuts, zone).join(sample, zone)
    mean = ws.save(known.mapInArrow(_passes(c), f"label {kind}, dims int, mean array<double>, passes int"))
    planned = classes.select(*zone, "embedding", "rep").join(mean, zone)
    size = planned.agg(F.coalesce(F.sum("passes"), F.lit(0))).first()[0]  # one row
    return planned.select(*zone, "embedding", "mean", "rep", "passes").mapInArrow(_codes(c.bits), fields), size


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows, dtype=np.int64))], [*b.schema.names, "part", "row"])
        n += b.num_rows


def _stars(near: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
    """Each vector that is linked, with the first one of its component."""
    todo, out = near.any(axis=1), []
    while todo.any():
        first = int(np.argmax(todo))
        group = np.zeros(len(near), bool)
        group[first] = True
        edge = group.copy()
        while edge.any():
            edge = near[edge].any(axis=0) & ~group
            group |= edge
        todo &= ~group
        out += [(int(rep[first]), int(r)) for r in rep[group] if r != rep[first]]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [*zip(*(b.column(k).to_pylist() for k in keys))]
        edges = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for s, e in zip(edges, edges[1:]):
            if held and rows[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = rows[s]
    if held:
        yield pa.Table.from_batches(held)


def _window(c: EmbeddingConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["block"]):
            t = t.combine_chunks()
            zone = [*zip(t["pass"].to_pylist(), t["label"].to_pylist(), t["dims"].to_pylist())]
            edges = [0, *(i for i in range(1, len(zone)) if zone[i] != zone[i - 1]), len(zone)]
            rep, pairs = np.array(t["rep"]), []
            for s, e in zip(edges, edges[1:]):
                x = _units(_matrix(t["embedding"].slice(s, e - s).combine_chunks(), zone[s][2]))
                rough = x.astype(np.float32) @ x.astype(np.float32).T
                near = rough >= c.cosine + 1e-4
                i, j = np.nonzero((rough >= c.cosine - 1e-4) & ~near)  # too close to call in single precision
                near[i, j] = np.einsum("ij,ij->i", x[i], x[j]) >= c.cosine
                np.fill_diagonal(near, False)
                pairs += _stars(near, rep[s:e])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _count(c: EmbeddingConfig):
    """For each entry of a tile, the ids in the entries on the other side that it is linked with."""

    def entries(t: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, at = np.unique(np.array(t["entry"])[rows], return_inverse=True)
        mult = np.zeros(len(key), np.int64)
        mult[at] = np.array(t["mult"])[rows]
        return key, at, mult

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["component", "t1", "t2"]):
            t = t.combine_chunks()
            side, first, second = np.array(t["side"]), t["t1"][0].as_py(), t["t2"][0].as_py()
            one, two = np.flatnonzero(side == first), np.flatnonzero(side == second)
            (left, at_left, many_left), (right, at_right, many_right) = entries(t, one), entries(t, two)
            near = np.zeros((len(left), len(right)), bool)
            zone = np.array(t["zone"])
            for z in np.intersect1d(zone[one], zone[two]).tolist():
                a, b = np.flatnonzero(zone[one] == z), np.flatnonzero(zone[two] == z)
                vectors = lambda rows: _units(_matrix(t["embedding"].take(pa.array(rows)).combine_chunks(), t["dims"][int(rows[0])].as_py()))
                i, j = np.nonzero(vectors(one[a]) @ vectors(two[b]).T >= c.cosine)
                near[at_left[a[i]], at_right[b[j]]] = True
            if first == second:
                np.fill_diagonal(near, False)
                got = [(left, near @ many_right)]
            else:
                got = [(left, near @ many_right), (right, many_left @ near)]
            for ids, n in got:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["entry", "links"])

    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", config: EmbeddingConfig = EmbeddingConfig()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    c, spark = config, vectors.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "embeddings")
    kind = dict(vectors.dtypes)[vector_col]
    own = kind if kind == "array<float>" else "array<double>"  # what is stored is compared in double precision either way
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(own).alias("embedding"), F.col(label_col).alias("label"))
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = rows.withColumn("fit", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    fit = rows.where("fit").select("vec_id", "label", "embedding")
    classes = ws.save(fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("least")).withColumns({"dims": F.size("embedding"), "rep": F.monotonically_increasing_id()}))
    # Ids and their classes; an id in several classes links them.
    member = ws.save(fit.join(classes.select("label", "embedding", "rep"), ["label", "embedding"]).groupBy("vec_id", "rep").agg(F.count("*").alias("rows")).select("vec_id", "rep"))
    several = ws.save(member.groupBy("vec_id").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").select("vec_id", "first"))
    scattered = ws.save(member.join(several, "vec_id"))
    found = ws.save(_neighbours(ws, classes, c))
    near = components(ws, found.union(scattered.select("first", "rep")))

    component = member.join(near.withColumnRenamed("node", "rep"), "rep", "left").select("vec_id", F.coalesce("component", "rep").alias("component"))
    least = component.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = component.distinct().join(least, "component").select("vec_id", "component_id").distinct()

    # Entries: classes with the number of ids that stand in them alone, and scattered ids.
    alone = member.join(several.select("vec_id"), "vec_id", "left_anti").groupBy("rep").agg(F.count("*").alias("mult"))
    single = alone.select("rep", F.xxhash64(F.lit(0), "rep").alias("entry"), "mult")
    split = scattered.select("rep", F.xxhash64(F.lit(1), "vec_id").alias("entry"), F.lit(1).cast("long").alias("mult"))
    entry = ws.save(single.unionByName(split))
    placed = entry.join(near.withColumnRenamed("node", "rep"), "rep")
    sizes = ws.save(placed.groupBy("component").agg(F.ceil(F.count("*") / c.tile).alias("tiles")))
    tiled = placed.join(sizes, "component").withColumn("side", F.pmod(F.xxhash64("entry"), F.col("tiles")))
    tiled = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"t1": F.least("side", "o"), "t2": F.greatest("side", "o")})
    vector = classes.select("rep", "embedding", "dims", F.xxhash64("label", "dims").alias("zone"))
    tiled = tiled.select("component", "t1", "t2", "side", "rep", "entry", "mult").join(vector, "rep")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = tiled.repartition(partitions, "component", "t1", "t2").sortWithinPartitions("component", "t1", "t2").mapInArrow(_count(c), "entry long, links long")
    links = counted.groupBy("entry").agg(F.sum("links").alias("links"))
    total = ws.save(entry.join(links, "entry", "left").select("rep", "entry", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links")))
    lone = member.join(several.select("vec_id"), "vec_id", "left_anti").withColumn("entry", F.xxhash64(F.lit(0), "rep"))
    many = scattered.select("vec_id", "rep").withColumn("entry", F.xxhash64(F.lit(1), "vec_id"))
    told = lone.unionByName(many).join(total, ["rep", "entry"]).select("vec_id", "links").distinct()
    told = ws.save(told.join(named, "vec_id").withColumn("linked", F.lit(True)))
    out = rows.join(told, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _neighbours(ws: Workspace, classes: DataFrame, c: EmbeddingConfig) -> DataFrame:
    """Links ``a, b`` between classes that stand close in the order of some pass."""
    spark = classes.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes, size = _coded(ws, classes, c)
    partitions = max(least, math.ceil(size / 500_000))
    ordered = codes.repartitionByRange(partitions, "pass", "label", "dims", "code", "rep").sortWithinPartitions("pass", "label", "dims", "code", "rep")
    ordered = ws.save(ordered.mapInArrow(_numbered, ordered._jdf.schema().toDDL() + ", part int, row long"))
    before, start = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect()):  # a row a partition
        start.append((part, before))
        before += n
    offset = spark.createDataFrame(start, "part int, before long")
    ranked = ordered.join(F.broadcast(offset), "part").withColumn("rank", F.col("before") + F.col("row"))  # a row a partition
    own, over = F.floor(F.col("rank") / c.block), F.col("rank") % c.block
    dealt = ranked.withColumn("block", F.explode(F.when((over < c.window) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    dealt = dealt.select("block", "rank", "pass", "label", "rep").join(classes.select("rep", "embedding", "dims"), "rep")
    return dealt.repartition(partitions, "block").sortWithinPartitions("block", "rank").mapInArrow(_window(c), "a long, b long")
