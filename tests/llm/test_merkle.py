"""The Merkle manifest against a tree built by lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from attestry.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def proofs(digests):
    """Top, and of each node its list of (left, right) up to the top."""
    ways, owners, row = [[] for _ in digests], [[i] for i in range(len(digests))], digests
    while len(row) > 1:
        runs = [range(s, min(s + 3, len(row))) for s in range(0, len(row), 3)]
        for run in runs:
            for i in run:
                for o in owners[i]:
                    ways[o].append(([row[j] for j in run if j < i], [row[j] for j in run if j > i]))
        row, owners = [sha(*[row[i] for i in run]) for run in runs], [sum([owners[i] for i in run], []) for run in runs]
    return row[0], ways


def brute(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[d[1]].append(d)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = [], []
    for key in keys:
        rows = sorted(groups[key], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees.append((rows, *proofs([leaf(d) for d in rows])))
    root, upper = proofs([t[1] for t in trees])
    for (rows, subroot, ways), above in zip(trees, upper):
        for d, way in zip(rows, ways):
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None
            now = leaf((*d[:4], d[4].replace("\n", ""))) if hit else leaf(d)
            for left, right in way + above:
                now = sha(*left, now, *right)
            out.append((d[0], leaf(d), subroot, root, sha(*[x for pair in way + above for side in pair for x in side]), now, now == root))
    return out


def made(sizes, seed=1):
    rnd = random.Random(seed)
    docs, ids = [], iter(rnd.sample(range(10**6), sum(sizes.values())))
    for source, n in sizes.items():
        docs += [(next(ids), source, rnd.choice(["en", "ü", None]), rnd.choice([3, None]), rnd.choice(["a\nb", "ab", "", None, "é\n", "\n"])) for _ in range(n)]
    return docs


def run(spark, docs):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], SCHEMA + ", tree long, `at.n` long")
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)


@pytest.mark.parametrize("fan", [1, 2, 6])
def test_manifest(spark, monkeypatch, fan):
    """Small blocks, so that trees take up to five rounds; one source that holds most rows."""
    monkeypatch.setattr(merkle, "LEVELS", fan)
    monkeypatch.setattr(merkle, "FAN", 3**fan)
    docs = made({None: 4, "": 1, "hot": 100, "ß": 9, "z": 10, "Z": 27, **{f"s{i}": 2 for i in range(8)}})
    docs += [docs[0], docs[0], (7, "z", "en", 1, "x\ny"), (7, "z", "en", 1, "x\nz"), (None, "z", "en", 1, "a\nb"), (None, None, None, None, None)]
    assert run(spark, docs) == sorted(brute(docs), key=str)


@pytest.mark.parametrize("sizes", [{"one": 1}, {"one": 5}, {"a": 1, "b": 1, "c": 1, "d": 1}])
def test_small_trees(spark, sizes):
    docs = made(sizes)
    assert run(spark, docs) == sorted(brute(docs), key=str)


def test_empty_and_long(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = [(k, "s", None, None, "line\n" * 400_000) for k in range(4)]
    assert run(spark, docs) == sorted(brute(docs), key=str)
