import json
import random

import pytest

from pyspark.sql import functions as F

from attestry.sources import corpora, json_arrays


def test_source_tree_counts_lines_and_skips_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "x.py").write_text("one\ntwo\né")
    (tmp_path / "a" / "x.txt").write_text("no\n")
    (tmp_path / ".git" / "y.py").write_text("no\n")
    got = corpora.read_source_tree(spark, str(tmp_path), [".py", ".c"]).collect()
    assert [(r.path.split("/")[-1], r.lines, r.text) for r in got] == [("x.py", 2, "one\ntwo\né")]


def test_provenance_records_and_baseline(spark, tmp_path):
    folder = tmp_path / "provenance"
    folder.mkdir()
    (folder / "a.json.prov.json").write_text(json.dumps({"artifact": "a.json", "joern_version": "v1", "schema_version": 1}))
    (folder / "b.json.prov.json").write_text("{broken")
    (folder / "unattributed.json").write_text(json.dumps({"artifacts": {"c.json": {"artifact_sha256": "s", "reason": "old"}}}))
    records, baseline = corpora.read_provenance(spark, str(tmp_path))
    assert {r.artifact: (r.parser_version, r.unreadable) for r in records.collect()} == {"a.json": ("v1", False), "b.json": (None, True)}
    assert [tuple(r) for r in baseline.collect()] == [("c.json", "s", "old")]


def test_report_is_sorted_and_slim(spark, tmp_path):
    df = spark.sql("SELECT id, id % 7 AS k, array(named_struct('name', 't', 'status', 'flagged'), named_struct('name', 'u', 'status', 'clean_static')) AS theorems FROM range(500)")
    out, schema = str(tmp_path / "report"), "id BIGINT, k BIGINT, theorems ARRAY<STRUCT<name: STRING, status: STRING>>"
    for limit in (0, 500):  # the second report takes the place of the first
        corpora.write_report(df.orderBy(F.desc("id")).limit(limit), out, ["k", "id"])
        back = corpora.read_report(spark, out, schema).orderBy("part", "place").collect()
        assert [(r.k, r.id) for r in back] == sorted((i % 7, i) for i in range(limit)) and all([t.name for t in r.theorems] == ["t"] for r in back)
    manifest = next((tmp_path / "report" / "manifest").glob("part-*"))
    manifest.write_text(manifest.read_text().replace('"rows":', '"rows":1'))
    with pytest.raises(Exception, match="manifest"):
        corpora.read_report(spark, out, schema)


def test_problem_lines_have_the_same_numbers_on_any_cluster(spark, tmp_path):
    lines = []
    for i in range(900):
        row = {"spec": "theorem t : True" if i % 5 else "", "is_canonical": i % 3 == 0, "impl": "x" * (i % 40)} | ({"id": f"p{i}"} if i % 4 == 0 else {})
        lines += [json.dumps(row)] + ([""] if i % 50 == 0 else []) + (["{broken"] if i % 77 == 0 else [])
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    want = []
    for n, line in enumerate(lines, 1):
        row = json.loads(line) if line.startswith("{\"") else {}
        if row.get("spec"):
            want.append((row.get("id", f"line{n}"), row["is_canonical"]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "9k", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            path = str(tmp_path / "p.jsonl")
            got = corpora.read_problems(spark, path)
            assert [(r.problem_id, r.is_canonical) for r in got.orderBy("line_no").collect()] == want
            for limit in (1, 100, 10_000):
                first = corpora.read_problems(spark, path, limit).orderBy("line_no").collect()
                assert [r.problem_id for r in first] == [w[0] for w in want[:limit]]
            canonical = corpora.read_problems(spark, path, 50, True).orderBy("line_no").collect()
            assert [r.problem_id for r in canonical] == [w[0] for w in want if w[1]][:50]
            assert sorted(r.line_no for r in corpora.bad_problem_lines(spark, path).collect()) == [n for n, line in enumerate(lines, 1) if line == "{broken"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def made_functions(n, seed=1):
    rnd = random.Random(seed)
    odd = ['quote " in it', "brace } and { and ]", "back \\ slash", '\\"', "é \n", "", "]", "[", 'end\\\\"}']
    return [{"name": f"f{i}", "file": rnd.choice(["a.py", "b.c"]), "params": rnd.sample(odd, 2), "vararg": rnd.choice(odd), "body": {"k": "str", "v": "".join(rnd.choices(odd, k=rnd.randrange(30)))}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_functions_of_one_array_are_read_by_many_tasks(spark, tmp_path, indent):
    """Splits of two kilobytes; strings with brackets, quotes and backslashes go over their borders."""
    made = {"m": made_functions(400), "n": made_functions(1), "none": []}
    for module, functions in made.items():
        (tmp_path / f"ast-{module}.json").write_text(json.dumps(functions, indent=indent, ensure_ascii=False))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        splits = json_arrays.fragments(spark, str(tmp_path / "ast-m.json")).select("split").distinct().count()
        got = corpora.read_functions(spark, str(tmp_path / "ast-*.json")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 20
    rows = sorted((r.module, r.pos, r.name, r.file, r.params, r.vararg, json.loads(r.body), r._corrupt) for r in got)
    assert rows == [(m, i, f["name"], f["file"], f["params"], f["vararg"], f["body"], None) for m in sorted(made) for i, f in enumerate(made[m])]


def test_broken_corpora_are_reported(spark, tmp_path):
    good = made_functions(3)
    for name, text in {"good": json.dumps(good), "cut": json.dumps(good)[:-30], "object": '{"name": "x"}', "none": " [ ]\n", "scalars": "[1, 2]", "odd": '[{"name": "a"}, {"name": }]', "open": '[{"name": "a"}'}.items():
        (tmp_path / f"ast-{name}.json").write_text(text)
    errors = {r.path.split("/")[-1][4:-5]: r.error for r in corpora.corpus_errors(spark, str(tmp_path / "ast-*.json")).collect()}
    assert errors == {"cut": "unreadable", "object": "not an array", "none": "empty corpus", "scalars": "unreadable", "odd": "unreadable", "open": "unreadable"}
    kept = [r.name for r in corpora.read_functions(spark, str(tmp_path / "ast-cut.json")).orderBy("pos").collect()]
    assert kept == ["f0", "f1", None]
