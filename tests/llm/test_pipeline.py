"""The pipeline on a fixture against brute force, and registered queries against their SQL."""

import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from attestry.llm.queries import ORACLE, QUERIES
from tokenizers import Tokenizer

from . import brute
from .test_models import tongue_docs

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert text(got.select(*columns).collect()) == text(cursor.fetchall())


def test_pipeline(spark, tmp_path):
    rnd = random.Random(8)
    docs = [(i, t.replace(" ta", "\nta").replace("ung ", "ung\n"), lang) for i, t, lang in tongue_docs(50, 21)]
    items = [(k, " ".join(f"b{rnd.randrange(99)}{'aeiou'[k]}" for _ in range(12))) for k in range(3)]
    word = lambda: "".join(rnd.choice(["ta", "ri", "no", "ka"]) for _ in range(3))
    long = [word() for _ in range(60)]
    docs += [(50 + k, " ".join([*long[:30], word(), *long[30:]]), "aa") for k in range(4)]
    docs += [(60, f"ri no ka {items[1][1]} mo", "aa"), (61, None, "aa"), (62, "Κόσμε Ελλάδα", "bb"), (63, "123", None)]
    folder = str(tmp_path / "sf")
    table = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()

    labelled = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2 and lang and t]
    found = brute.languages(labelled, [d[:2] for d in docs], 400)
    left = [(i, t) for i, t, _ in docs if found[i][0] != "und" and found[i][1] >= 0.25]
    left = list(brute.dedup_lines(left).items())
    near = brute.near_copies(left)
    left = [(i, t) for i, t in left if near[i] == i]
    bad = {i for i, *_ in brute.contaminated(left, items)}
    left = [(i, t) for i, t in left if i not in bad]
    assert {61, 62, 63}.isdisjoint(i for i, _ in left) and 60 in bad
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in left}
    assert {(r.doc_id, r.ids_crc32, r.doc_tokens) for r in rows} == {(i, zlib.crc32(x.tobytes()), len(x)) for i, x in want.items()}
