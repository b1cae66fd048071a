"""Near-duplicate vectors against all pairs."""

import math
import random

import numpy as np
from attestry.llm import embedding_dedup
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>"


def unit(v):
    v = np.array(v, float) / max(map(abs, v))
    return v / np.linalg.norm(v)


def brute(rows, threshold=0.95):
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = [unit(v) if ok else None for ok, (_, v) in zip(usable, rows)]
    links = [set() for _ in rows]
    for dim in {len(u) for u in units if u is not None}:
        own = [i for i, u in enumerate(units) if u is not None and len(u) == dim]
        near = np.array([units[i] for i in own])
        for a, b in zip(*np.nonzero(near @ near.T >= threshold)):
            if a != b:
                links[own[a]].add(own[b])
    component = list(range(len(rows)))
    for i in range(len(rows)):
        if component[i] == i:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            for j in seen:
                component[j] = i
    least = {}
    for i, c in enumerate(component):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return [(vec, len(links[i]), least.get(component[i]), vec is not None and vec == least.get(component[i])) for i, (vec, _) in enumerate(rows)]


def near(rnd, v, cosine):
    """A vector at just that cosine to v."""
    other = rnd.standard_normal(len(v))
    other -= (other @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * unit(other)


def made(seed, dim=32):
    rnd = np.random.default_rng(seed)
    vectors = [unit(rnd.standard_normal(dim)) for _ in range(300)]
    for k in range(12):
        vectors += [near(rnd, vectors[k], c) for c in (0.952, 0.97, 0.99, 0.9495)]
    chain = [vectors[20]]
    for _ in range(25):
        chain.append(near(rnd, chain[-1], 0.96))
    vectors += chain[1:] + [near(rnd, vectors[21], 0.985) for _ in range(60)] + [vectors[22]] * 40 + [vectors[22] * 4]
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]


ODD = [
    (9000, None), (9001, []), (9002, [0.0, 0.0]), (9003, [1.0, None]), (9004, [float("nan"), 1.0]), (9005, [float("inf"), 1.0]),
    (9006, [1.0, 0.0]), (9007, [5.0, 0.0]), (9007, [5.0, 0.0]), (None, [1.0, 0.0]), (None, None), (None, [0.0, -1.0]), (9008, [1e308, 1e308]), (9009, [1e-320, 1e-320]), (9010, [3.0]), (9011, [-3.0]),
]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cls": F.lit(1), "root": F.lit(2), "a.b": F.lit(3)})
    return sorted((tuple(r) for r in embedding_dedup.near_duplicates(df, **options).collect()), key=str)


def test_all_links(spark):
    rows = made(1) + ODD
    random.Random(1).shuffle(rows)
    assert run(spark, rows, passes=12) == sorted(brute(rows), key=str)


def test_large_components_in_tiles(spark):
    """Components above a tile: half the angle around the mean without comparisons, the others tile by tile; small windows and blocks."""
    rows = made(2) + ODD
    assert run(spark, rows, tile=7, window=8, block=64, passes=14) == sorted(brute(rows), key=str)


def test_recall_at_the_threshold(spark):
    """Pairs at the threshold, with the passes that the number of rows gives: at least 0.9 of the links are found."""
    rnd = np.random.default_rng(3)
    vectors = [unit(rnd.standard_normal(64)) for _ in range(6000)]
    vectors += [near(rnd, v, 0.9505) for v in vectors[:600]]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {r[0]: r for r in run(spark, rows)}
    assert sum(got[6000 + i][2] == i for i in range(600)) >= 0.95 * 600
    assert all(got[i][1] == 0 for i in range(600, 6000))


def test_passes_grow_with_the_table():
    counts = [embedding_dedup.passes_for(n) for n in (1, 10**3, 10**6, 10**9)]
    assert counts == sorted(counts) and counts[-1] < 100


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]
