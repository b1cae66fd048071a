"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes, writes the side of each as a bit and orders the vectors by these bits, read as one number from
the first bit on. Vectors at a small angle share a long prefix and stand near each other in some pass. Each vector is compared
with the next `WINDOW` vectors of the order, exactly and in double precision, and pairs at the threshold are united across passes.

The window bounds what a pass compares, not what is linked: the components are found first, then the links inside each component
are counted exactly. A component of up to `TILE` vectors is one product of matrices. Of a larger one, vectors within half the
threshold's angle of the component's mean are linked to each other by the triangle inequality, without a comparison; the others
are compared with all vectors of the component, tile by tile.

The number of passes follows the number of vectors: a pair at the threshold is found by one pass with probability
`(1 - angle / pi) ** log2(n / WINDOW)` at least, roughly, and there are as many passes as a recall of `RECALL` for such pairs takes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import prepare, written
from attestry.llm.components import components
from attestry.llm.ordering import ranked

THRESHOLD = 0.95
RECALL = 0.99
WINDOW = 64
BITS = 63
BLOCK = 2048
TILE = 1024
SEED = 13
MIN_PASSES = 6  # chains need each of their links


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    agree = 1 - math.acos(threshold) / math.pi
    found = agree ** max(1.0, math.log2(max(2, n) / window))
    return max(MIN_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _vectors(column: pa.Array) -> list:
    """Of each row the vector in double precision, None where it can't be compared."""
    out = []
    for v in column.to_pylist():
        if not v or None in v:
            out.append(None)
            continue
        v = np.array(v, np.float64)
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # so that squares neither overflow nor vanish
    return v / math.sqrt(float(v @ v))


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, digest, unit): 128 bits that name the vector, and the vector at length one in double precision."""
    for batch in batches:
        units = [None if v is None else _unit(v).astype("<f8").tobytes() for v in _vectors(batch.column(1))]
        digests = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "digest", "unit"])


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)


def _keys(number: int):
    """(cls, key, dim) of a pass: the sides of its hyperplanes as one number, the first hyperplane in the highest bit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            units, keys = batch.column(1).to_pylist(), []
            dims = [len(u) // 8 for u in units]
            for u, dim in zip(units, dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, number, dim]).standard_normal((BITS, dim))
                # One vector at a time: its bits don't depend on the batch it travels in.
                bits = np.packbits(np.concatenate(([False], planes[dim] @ np.frombuffer(u, "<f8") > 0)))
                keys.append(int.from_bytes(bits.tobytes(), "big"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(dims, pa.int64())], names=["cls", "key", "dim"])

    return rows


def _runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[dict]:
    """Rows sorted by `by` as column lists of one run of equal values each."""
    held: dict = {}
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(*[columns[c] for c in by]))
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            part = {c: v[start:end] for c, v in columns.items()}
            if held and held["_at"] != keys[start]:
                yield held
                held = {}
            held = {c: held[c] + v for c, v in part.items()} | {"_at": keys[start]} if held else part | {"_at": keys[start]}
            start = end
    if held:
        yield held


def _windows(threshold: float, window: int, block: int):
    """Blocks of the order, each with the first of the next, to links that hold together what the windows have linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "block"):
            at = sorted(range(len(run["rank"])), key=run["rank"].__getitem__)
            cls, dims = [run["cls"][i] for i in at], [run["dim"][i] for i in at]
            top = list(range(len(at)))

            def root(i: int) -> int:
                while top[i] != i:
                    top[i] = top[top[i]]
                    i = top[i]
                return i

            out, low = [], 0
            while low < len(at):
                high = low
                while high < len(at) and dims[high] == dims[low]:
                    high += 1
                x = _matrix([run["unit"][i] for i in at[low:high]])
                for start in range(0, high - low, 256):
                    own = x[start : start + 256]
                    i, j = np.nonzero(own @ x[start : start + 256 + window].T >= threshold)
                    inside = (i < j) & (j <= i + window)
                    for i, j in zip((i[inside] + low + start).tolist(), (j[inside] + low + start).tolist()):
                        a, b = root(i), root(j)
                        if a != b:
                            top[max(a, b)] = min(a, b)
                            out.append((cls[i], cls[j]))
                low = high
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows


def _pass(classes: DataFrame, number: int, threshold: float, window: int, block: int) -> DataFrame:
    """(a, b): links of one pass, those that its blocks need to hold together."""
    keys = ranked(classes.select("cls", "unit").mapInArrow(_keys(number), "cls long, key long, dim long"), ["dim", "key", "cls"])
    own = F.floor(F.col("rank") / block).cast("long")
    guest = F.when((F.col("rank") % block < window) & (own > 0), own - 1)
    places = keys.select("cls", "dim", "rank", F.explode(F.array_compact(F.array(own, guest))).alias("block"))
    sides = places.join(classes.select("cls", "unit"), "cls").repartition("block").sortWithinPartitions("block")
    return sides.mapInArrow(_windows(threshold, window, block), "a long, b long")


def _linked(run: dict, threshold: float, left: list[int], right: list[int]) -> np.ndarray:
    """Which of `left` and `right` of a run are linked; vectors of another length are not."""
    dims = np.array([len(u) for u in run["unit"]])
    out = np.zeros((len(left), len(right)), bool)
    left_dims, right_dims = dims[left], dims[right]
    for dim in set(left_dims.tolist()):
        i, j = np.flatnonzero(left_dims == dim), np.flatnonzero(right_dims == dim)
        if len(j):
            out[np.ix_(i, j)] = _matrix([run["unit"][left[k]] for k in i]) @ _matrix([run["unit"][right[k]] for k in j]).T >= threshold
    return out


def _count_small(threshold: float):
    """Links inside whole components."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "root"):
            every, copies = list(range(len(run["cls"]))), np.array(run["copies"])
            near = _linked(run, threshold, every, every)
            np.fill_diagonal(near, False)
            yield pa.RecordBatch.from_arrays([pa.array(run["cls"], pa.int64()), pa.array(near @ copies)], names=["cls", "links"])

    return rows


def _count_tiles(threshold: float):
    """Links between a tile of outer vectors and a tile of the component: for the outer ones all, for the inner ones those to outer ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "root", "mine", "other"):
            asks = np.array(run["asks"])
            left, right = np.flatnonzero(asks).tolist(), np.flatnonzero(~asks).tolist()
            if not left or not right:
                continue
            cls, copies, inner = np.array(run["cls"]), np.array(run["copies"]), np.array(run["inner"])
            near = _linked(run, threshold, left, right) & (cls[left][:, None] != cls[right][None, :])
            back = np.flatnonzero(inner[right])
            out = [cls[left], cls[right][back]], [near @ copies[right], copies[left] @ near[:, back]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("int64")) for x in out], names=["cls", "links"])

    return rows


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [np.frombuffer(u, "<f8").tolist() for u in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.float64()))], names=["cls", "root", "parts"])


def _links_of_large(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(cls, links) of components too large for one product; members have (root, cls, copies, unit)."""
    half = math.cos(math.acos(threshold) / 2 - 1e-6)  # a little inside, so that rounding never makes a link
    parts = members.select("cls", "root", "unit").mapInArrow(_flat, "cls long, root long, parts array<double>")
    long = written(parts.select("cls", "root", F.size("parts").alias("dim"), F.posexplode("parts").alias("i", "x")))
    means = long.groupBy("root", "dim", "i").agg(F.sum("x").alias("m"))
    norms = means.groupBy("root", "dim").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    near = long.join(means, ["root", "dim", "i"]).groupBy("cls", "root", "dim").agg(F.sum(F.col("x") * F.col("m")).alias("dot"))
    inner = near.join(norms, ["root", "dim"]).filter(F.col("dot") >= half * F.col("norm")).select("cls", F.lit(True).alias("inner"))
    dims = F.octet_length("unit")
    told = written(members.join(inner, "cls", "left").select("root", "cls", "copies", "unit", F.coalesce("inner", F.lit(False)).alias("inner"), dims.alias("dim")))
    sizes = told.filter("inner").groupBy("root", "dim").agg(F.sum("copies").alias("all"))
    within = told.filter("inner").join(sizes, ["root", "dim"]).select("cls", (F.col("all") - F.col("copies")).alias("links"))
    # Tiles of about `tile` vectors; each tile of outer vectors meets each tile of its component.
    counts = told.groupBy("root").agg(F.count("*").alias("every"), F.count_if(~F.col("inner")).alias("outer"))
    counts = counts.filter("outer > 0").select("root", F.ceil(F.col("every") / tile).cast("int").alias("tiles"), F.ceil(F.col("outer") / tile).cast("int").alias("asking"))
    dealt = told.join(counts, "root")
    spot = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    columns = ["root", "cls", "copies", "unit", "inner"]
    asks = dealt.filter("NOT inner").select(*columns, F.lit(True).alias("asks"), spot("asking").alias("mine"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    asked = dealt.select(*columns, F.lit(False).alias("asks"), F.explode(F.expr("sequence(0, asking - 1)")).alias("mine"), spot("tiles").alias("other"))
    met = asks.unionByName(asked).repartition("root", "mine", "other").sortWithinPartitions("root", "mine", "other")
    return within.unionByName(met.mapInArrow(_count_tiles(threshold), "cls long, links long"))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, block: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of `vectors`.

    Vectors that are equal at length one are one class with its number of copies. A vector that is null, empty, zero or holds
    something null or not finite links with nothing and is its own component; vectors of different lengths are never linked. Rows
    that repeat a vec_id are vectors of their own, which share a component if they are linked. A null id is carried; the
    component takes the smallest id that is not null, and nothing of a null id is kept. Ties do not arise: components and counts
    do not depend on the order within a window. An empty table gives an empty result; of extra columns none is read.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(_told_apart, "vec_id long, digest binary, unit binary"))
    apart = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = written(apart.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    found = spark.createDataFrame([], "a long, b long")
    for number in range(passes or passes_for(n, threshold, window)):
        found = found.unionByName(written(_pass(classes, number, threshold, window, block)))
    roots = written(components(found).select(F.col("node").alias("cls"), "root"))
    members = written(roots.join(classes.select("cls", "copies", "unit", "least"), "cls"))
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.min("least").alias("component"))
    sized = written(members.join(sizes, "root"))
    small = sized.filter(F.col("size") <= tile).select("root", "cls", "copies", "unit").repartition("root").sortWithinPartitions("root")
    links = small.mapInArrow(_count_small(threshold), "cls long, links long")
    large = sized.filter(F.col("size") > tile).select("root", "cls", "copies", "unit")
    if not large.isEmpty():
        links = links.unionByName(_links_of_large(large, threshold, tile))
    links = links.groupBy("cls").agg(F.sum("links").alias("links"))
    told = classes.select("cls", "digest", "copies", "least").join(links, "cls", "left").join(sized.select("cls", "component"), "cls", "left")
    told = told.select(F.col("digest").alias("_digest"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = rows.select("vec_id", "digest").join(told, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
