"""Exact dedup, components, line dedup, similarity join and decontamination against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from attestry.llm import components, decontamination, exact_dedup, line_dedup, linking, ngram_join
from pyspark.sql import functions as F

from . import brute


def with_clashes(df):
    names = ("key", "text_hash", "row", "h", "n", "cls", "name", "root", "block", "pos", "line", "gone", "item_id", "doc", "_n_lines", "_n_dropped", "_bad_key", "_bad_text", "a.b", "c`d")
    return df.withColumns({c: F.lit("x") for c in names})


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(600, k) for k in range(601, 660)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.roots({x for p in links for x in p}, links)
    lone = {a for a, b in links if a == b} - set(got)
    assert {k: v for k, v in want.items() if k not in lone} == got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components_are_followed(spark):
    rounds = [{1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 8: 7, 7: 7}, {1: 1, 3: 1, 5: 3}, {1: 1, 3: 1}]
    tables = [spark.createDataFrame(list(r.items()), "node long, up long") for r in rounds]
    got = sorted(map(tuple, components.followed(tables).collect()))
    assert got == [(k, 1) for k in range(1, 7)] + [(7, 7), (8, 7)]


@pytest.mark.parametrize("percent, turns", [(80, 3), (80, 1), (80, 0), (60, 3), (100, 3)])
def test_near_copies_around_the_threshold(spark, percent, turns):
    """One key of copies of which most are too far from each other: looked at are few pairs, and no link is lost."""
    rnd = random.Random(percent)
    base, fresh = list(range(100)), iter(range(1000, 100_000))
    sets = {0: set(base), 1: {next(fresh) for _ in range(90)}}
    for k in range(2, 250):
        of = set(rnd.choice(list(sets.values())) if k % 5 == 0 else base)
        for _ in range(rnd.choice([0, 1, 3, 4, 5, 5, 6, 9])):
            at = rnd.randrange(100)
            of = of - set(range(at, at + 4)) | {next(fresh) for _ in range(rnd.choice([0, 4, 4, 4]))}
        sets[k] = of
    sets[250] = set(base[:10])
    looked = []

    def verified(pairs):
        rows = [(r.a, r.b) for r in pairs.collect()]
        looked.extend(rows)
        return spark.createDataFrame([(a, b) for a, b in rows if (100 + percent) * len(sets[a] & sets[b]) >= percent * (len(sets[a]) + len(sets[b]))], "a long, b long")

    items = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "cls long, items array<long>")
    index = spark.createDataFrame([(key, k, 1) for key in (5, 6) for k in sets], "key long, cls long, least long")
    got = linking.linked(index, verified, lambda classes: items.join(classes, "cls", "left_semi"), percent, small=16, turns=turns)
    links = [(a, b) for a in sets for b in sets if a < b and (100 + percent) * len(sets[a] & sets[b]) >= percent * (len(sets[a]) + len(sets[b]))]
    root = {r.node: r.root for r in got.collect()}
    assert {k: root.get(k, k) for k in sets} == {k: r for k, r in brute.roots(set(sets), links).items()}
    if turns == 3:
        assert len(looked) < 15 * len(sets)


@pytest.mark.parametrize("block_hash", [F.xxhash64, lambda b: F.crc32(b) % 5])
def test_exact_dedup(spark, block_hash):
    rnd = random.Random(5)
    pool = ["", "a", "ä" * 40, "x" * 64, "x" * 65, "y" * 64 + "x" * 64, "x" * 64 + "y" * 64, *("".join(rnd.choice("ab") for _ in range(rnd.choice([63, 128, 300]))) for _ in range(8))]
    docs = [(i, rnd.choice(pool) if i % 11 else None) for i in range(120)] + [(7, "once more"), (None, "a"), (None, "nobody")]
    docs += [docs[3]] * 4
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = exact_dedup.exact_dedup(df, block_bytes=32, block_hash=block_hash)
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    want = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(want) and set(rows) == want
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def near_texts(seed, n, lines=False):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    common = [word() for _ in range(40)]
    bases = [[word() for _ in range(rnd.choice([3, 6, 30, 80, 200]))] for _ in range(8)] + [[*common, word()] for _ in range(4)]
    out = []
    for i in range(n):
        ws = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            ws[rnd.randrange(len(ws))] = word().upper()
        if rnd.random() < 0.2:
            ws += common
        sep = (lambda: "\n" if rnd.random() < 0.1 else " ") if lines else (lambda: rnd.choice([" ", "\t", "\n "]))
        out.append((i, "".join(w + sep() for w in ws)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, out[0][1]), (n + 4, out[0][1])]
    return out


@pytest.mark.parametrize(("share", "paired", "small"), [(1 / 512, 300, 128), (0.02, 300, 4), (0.02, 40, 3), (2.0, 300, 2)])
def test_similarity_components(spark, share, paired, small):
    docs = near_texts(11, 90)
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).coalesce(1)
    got = ngram_join.similarity_components(df, common_share=share, paired=paired, small=small)
    near = brute.near_copies(docs)
    assert sorted(map(tuple, got.collect())) == sorted((i, len(brute.shingles(t)), near[i]) for i, t in docs)


def test_join_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "A b"), (None, "c"), (5, "a  b"), (5, "a  b"), (6, None), (6, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similarity_components(df).collect())
    assert got == sorted([("None", 1, "5"), ("None", 1, "5"), ("None", 1, "None"), ("5", 1, "5"), ("5", 1, "5"), ("6", 0, "6"), ("6", 0, "6")])
    kept = sorted((str(r.doc_id), str(r.text)) for r in ngram_join.one_of_each(with_clashes(df)).collect())
    assert kept == [("5", "a  b"), ("6", "None"), ("6", "None"), ("None", "c")]
    assert ngram_join.similarity_components(df.limit(0)).count() == 0 and ngram_join.one_of_each(df.limit(0)).count() == 0


def test_line_dedup(spark):
    docs = near_texts(13, 40, lines=True)
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = line_dedup.dedup_lines(df, sketch=200, band=1, mark=3)
    assert {r.doc_id: r.text for r in got.collect()} == brute.dedup_lines(docs)
    assert set(df.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_banding_has_high_recall(spark):
    rnd = random.Random(2)
    docs = []
    for i in range(150):
        line = "".join(rnd.choice("abcdefghij   ") for _ in range(rnd.randint(150, 400)))
        other = list(line)
        for _ in range(2):
            other[rnd.randrange(len(other))] = "X"
        docs += [(2 * i, line), (2 * i + 1, "".join(other))]
    linked = sum((180 * len(a & b) >= 80 * (len(a) + len(b))) for a, b in ((brute.char_shingles(x[1], 8), brute.char_shingles(y[1], 8)) for x, y in zip(docs[::2], docs[1::2])))
    dropped = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).filter("_n_dropped > 0").count()
    assert linked >= dropped >= 0.97 * linked > 100


def test_short_lines_have_high_recall(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    changes = {"stop": lambda t: t + ".", "last": lambda t: t[:-1] + "#", "word": lambda t: f"{t} {word()}"}
    docs, linked = [], {}
    for n in (3, 4, 5, 6, 8, 12):
        for name, change in changes.items():
            for _ in range(80):
                line = " ".join(word() for _ in range(n))
                other = change(line)
                a, b = brute.char_shingles(line, 8), brute.char_shingles(other, 8)
                if len(line) > 8 and 180 * len(a & b) >= 80 * (len(a) + len(b)):
                    linked[len(docs) + 1] = n, name
                    docs += [(len(docs), line), (len(docs) + 1, other)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    dropped = {r.doc_id for r in got.filter("_n_dropped > 0").collect()}
    missed = [case for i, case in linked.items() if i not in dropped]
    assert len(linked) > 600 and len(missed) <= 0.02 * len(linked), missed


def test_line_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "line one\nx"), (1, "line one\n\n y"), (1, "line one\n\n y"), (2, " y\nx"), (3, "\n\n")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r._n_lines, r._n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted([("None", "", 2, 2), ("1", "line one\n\n y", 2, 0), ("1", "line one\n\n y", 2, 0), ("2", "x", 2, 1), ("3", "\n\n", 0, 0)])


def test_contaminated(spark):
    rnd = random.Random(17)
    word = lambda: rnd.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([1, 4, 5, 12, 30, 60])))) for k in range(12)] + [(12, None), (13, " "), (14, "Un ä ö ü ß e f")]
    docs = []
    for i in range(80):
        part = (rnd.choice(items)[1] or "").split()
        for _ in range(rnd.choice([0, 0, 1, 3])):
            if part:
                part[rnd.randrange(len(part))] = "zz"
        docs.append((i, " ".join([*(word() for _ in range(rnd.choice([0, 5, 300]))), *[p.title() for p in part], *(word() for _ in range(rnd.choice([0, 9])))])))
    docs += [(80, None), (81, ""), (82, items[1][1])]
    df, bench = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contaminated(df, bench).collect())
    want = sorted(brute.contaminated(docs, items))
    assert got == want and len(got) > 10
    clean = decontamination.decontaminate(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {w[0] for w in want}
    assert decontamination.contaminated(df.limit(0), bench).count() == 0 and decontamination.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_contamination_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "b c d e f"), (9, "b c d e f"), (None, "A B C D E")], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontamination.contaminated(df, bench).collect())
    assert got == [("1", "9"), ("1", "None"), ("None", "9"), ("None", "None")]
    assert [r.text for r in decontamination.decontaminate(df, bench).collect()] == ["other"]


def test_stages_apply_to_their_own_results(spark):
    docs = [(0, "one line of text\nanother line here"), (1, "one line of text\nthird"), (2, None)]
    once = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    twice = line_dedup.dedup_lines(once.withColumn("x.y", F.lit(1)))
    assert twice.columns == ["doc_id", "text", "x.y", "_n_lines", "_n_dropped"]
    assert sorted((r.doc_id, r.text, r._n_dropped) for r in twice.collect()) == [(0, docs[0][1], 0), (1, "third", 0), (2, "", 0)]
