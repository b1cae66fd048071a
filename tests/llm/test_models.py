"""Language profiles, toxicity, LM scores and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
from attestry.llm import common, language_id, lm_scoring, packing, toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
TONGUES = {"aa": ["ta", "ri", "no", "ka", "mo"], "bb": ["sch", "ung", "ein", "ß", "über"], "cc": ["ción", "que", "ñ", "os", "el"]}


def tongue_docs(n, seed=1):
    rnd = random.Random(seed)
    docs = []
    for i in range(n):
        lang = rnd.choice(list(TONGUES))
        docs.append((i, " ".join("".join(rnd.choice(TONGUES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 60))), lang))
    return docs


def crc(i):
    return zlib.crc32(str(i).encode())


def test_languages(spark):
    docs = tongue_docs(80) + [(80, None, "aa"), (81, "12 !", "bb"), (82, "Κόσμε", None), (83, "", None), (84, "Ünd.SCHÖN", "bb")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "gram": F.lit(2)})
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    labelled = [(t, lang) for i, t, lang in docs if crc(i) % 4 != 2 and lang and t]
    want = brute.languages(labelled, [(i, t) for i, t, _ in docs], language_id.PROFILE_SIZE)
    assert {i: r.lang_pred for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(abs(got[i].score - w[1]) < 1e-9 for i, w in want.items()) and all(r.held_out == (crc(i) % 4 == 2) for i, r in got.items())
    right = [got[i].lang_pred == lang for i, t, lang in docs[:80] if crc(i) % 4 == 2]
    assert sum(right) == len(right) > 10
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in want if i not in (80, 81, 82, 83)}


def test_languages_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "abc", "x"), (1, "abc", None), (1, "abc", None)], "doc_id long, text string, lang string")
    assert sorted((r.lang_pred, r.score, r.held_out) for r in language_id.identify(df).collect()) == [("und", 0.0, False)] * 3
    assert language_id.identify(df.limit(0)).count() == 0 and language_id.keep_identified(df.limit(0)).count() == 0


def test_long_text_in_slices(monkeypatch):
    from attestry.llm import grams

    text = "Überlänge, ñandú und so weiter " * 40
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(grams, "SLICE", 64)
    parts = language_id.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_toxicity_of_held_out_and_misspelt(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8)))
    bad = ["grumblefock", "wretchpig", "snotgoblin"]
    docs, labels = [], []
    for i in range(400):
        ws = [word() for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                ws[rnd.randrange(len(ws))] = rnd.choice(bad)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    docs += [(400, "the grumblefokk and snotgobblin of wretchpigg"), (401, None), (402, ""), (None, "x"), (401, None)]
    labels += [(400, 2), (401, None), (5, 0), (999, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"toxic": F.lit(0), "rows": F.lit(1), "score": F.lit(1)})
    got = toxicity.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, dict(labels[:400])[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(got) == len(docs) and sum(p == y for p, y in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[400].predicted == 1 and 0 <= by[401].score == by[402].score < 0.5 and by[None].held_out is False
    none = toxicity.score_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.score_toxicity(df.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_lm_scores(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rnd.choice(words[: rnd.choice([4, 20, 60])]).title() for _ in range(rnd.choice([1, 2, 3, 40])))) for i in range(60)]
    docs += [(60, None), (61, " "), (62, "w1 w2\tw3\nw1 w2 w3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "gram", "n", "word")})
    got = {r.doc_id: (r.n_words, r.mean_log) for r in lm_scoring.score_documents(df, min_share=0.01).collect()}
    want = brute.lm_scores(docs, share=0.01)
    assert got.keys() == want.keys()
    assert all(got[i][0] == n and (got[i][1] is None if m is None else abs(got[i][1] - m) < 1e-9) for i, (n, m) in want.items())


def test_lm_scores_count_every_word(spark):
    rnd = random.Random(16)
    rare = [f"r{k}" for k in range(3000)]
    docs = [(i, " ".join(rnd.choice(["the", "of", *rare[i * 10 : i * 10 + 15]]) for _ in range(120))) for i in range(299)]
    docs += [(299, " ".join(f"never{k}" for k in range(200)))]
    got = {r.doc_id: r.mean_log for r in lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute.lm_scores(docs, share=0)
    assert all(abs(got[i] - m) < 1e-9 for i, (_, m) in want.items())
    assert got[299] == min(got.values())


def test_lm_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "a c")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, round(r.mean_log, 9)) for r in lm_scoring.score_documents(df).collect())
    assert [g[0] for g in got] == ["1", "1", "1", "None"] and got[0] != got[2] and got[1][2] == got[3][2] or got[0][2] == got[1][2]
    assert lm_scoring.score_documents(df.limit(0)).count() == 0


def test_first_fit_decreasing():
    for seed in range(60):
        rnd = random.Random(seed)
        lengths = sorted((rnd.randint(1, 64) for _ in range(rnd.randint(0, 90))), reverse=True)
        bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
        assert list(zip(bins.tolist(), offsets.tolist())) == brute.first_fit(lengths, 64)


def test_encoder_is_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    whole, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for seed in range(1500):
        rnd = random.Random(seed)
        t = "".join(rnd.choice("abAB'stre.,!| \n\t\x1c\x85\xa0ñÑß1２Σσé́İ²") for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "<|endoftext|>x", "<|EndOfText|>x", "plain <|ENDOFTEXT|> word", " DON'T."])
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_pack(spark):
    docs = tongue_docs(60, 9) + [(60, None), (61, ""), (None, "ta ri"), (3, "no"), (3, "no"), (62, "ka mo " * 400)]
    docs = [d[:2] for d in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"group": F.lit(1), "length": F.lit(2), "start": F.lit(3)})
    rows = packing.pack(df, PATH, sequence=64, group_pieces=16).collect()
    whole, want, got, bins = Tokenizer.from_file(PATH), [], [], {}
    for i, t in docs:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(str(i), s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    for r in rows:
        got.append((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(got) == sorted(want)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_worker_caches_are_freed_for_the_next_operator():
    one = common.worker_cache("one")
    one["a"] = 1
    assert common.worker_cache("one") is one and common.worker_cache("two") == {} and common.worker_cache("one") == {}


def test_lm_scores_ask_once_for_each_gram_of_a_chunk(spark):
    words = [f"w{k % 70}" for k in range(500)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(40)], "doc_id long, text string").coalesce(1)
    chunks = docs.mapInArrow(lm_scoring._chunks, lm_scoring.CHUNKS)
    assert [(r.n_words, len(r.ids)) for r in chunks.collect()] == [(40 * 500, 40)]
    asked = chunks.mapInArrow(lm_scoring._asked(None, 3, 7), lm_scoring.ASKED).collect()
    grams = np.concatenate([np.cumsum(lm_scoring.unpacked(r.grams, r.n, np.uint64), dtype=np.uint64) for r in asked])
    counts = np.concatenate([lm_scoring.unpacked(r.counts, r.n, np.int64) for r in asked])
    assert len(grams) == len(set(grams.tolist())) == 3 * 70 and counts.sum() == 40 * (500 + 499 + 498)
