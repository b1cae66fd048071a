"""A sample of registered queries against their SQL on the smallest tables."""

import json
from collections import Counter

import duckdb
import pytest
from attestry.plans import corpus

from attestry.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = ["a_functions", "a_problems", "a_report", "c_declaration_evidence", "d_coverage_ledger", "c_resolve_calls", "c_captures", "e_compare_outcomes", "f_idempotent", "g_attribute_errors", "h_screen", "i_audit_provenance", "j_roll_up", "k_casts"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert text(got.select(*[f"`{c}`" for c in columns]).collect()) == text(cursor.fetchall())


TEXTS = [
    ("en", "a bb ccc dddd eeeee ffffff ggggggg hhhhhhhh\none\n\nto be or not", "web"), ("en", "x" * 25 + " name y\nsix six six\n1 2 3 4", "web"), ("de", "dddd eeeee", "book"),
    ("de", "self!!! dddd\nan=b (self)-- ein zwei drei vier", "web"), (None, "q r", "web"), ("fr", "", "web"), ("fr", "dddd", "wiki"),
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The folder of a few documents, and the objects of each of their bodies, opened by json."""
    folder = str(tmp_path_factory.mktemp("small"))
    docs = [(i, text, lang, source, len(text)) for i, (lang, text, source) in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{folder}/documents.parquet")

    def objects(x):
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from objects(y)
        if isinstance(x, dict):
            yield x

    return folder, [(f.module, f.file, list(objects(json.loads(f.body)))) for f in corpus.functions(spark, folder).collect()]


def test_mutants_of_all_families(spark, small):
    folder, bodies = small
    want = Counter()
    for module, _, body in bodies:
        names = {"self", *(x["v"] for x in body if x["k"] == "name")}
        for x in body:
            k = x["k"]
            want[module, "ast-binop"] += k == "binop"
            want[module, "ast-int"] += 2 * (k == "int")
            want[module, "ast-field"] += k == "field"
            want[module, "ast-ret->expr"] += k == "ret"
            want[module, "ast-expr->ret"] += k == "exprS"
            want[module, "ast-seq-delete"] += k in ("assign", "exprS", "ret", "setIndex")
            want[module, "ast-name"] += k == "name" and len(names) > 1
            want[module, "ast-assign"] += k == "assign" and bool(names - {x["x"]})
    got = {(r.module, r.family): r.n for r in QUERIES["g_generate_mutants"](spark, folder).collect()}
    assert got == +want and {"ast-name", "ast-assign"} <= {family for _, family in got}


def test_all_rules_of_the_contract(spark, small):
    folder, bodies = small
    want = Counter()
    for module, file, body in bodies:
        want[module, "required_fields"] += 1
        want[module, "known_extension"] += 1
        for x in body:
            for rule, applies in {
                "int_exact": x["k"] == "int", "int_canonical": x["k"] == "int" and isinstance(x["v"], str), "bool_literal": x["k"] == "bool", "str_literal": x["k"] == "str",
                "hole_label": x["k"] == "hole", "label_namespaced": x["k"] == "hole", "import_vocabulary": x.get("label", "").startswith("import:"), "known_kind": True, "unquoted_literals": True,
            }.items():
                want[module, rule] += applies
    got = QUERIES["i_validate_contract"](spark, folder).collect()
    assert {(r.module, r.rule): r.checked for r in got} == dict(want) and len({r.rule for r in got}) == 11
    bad = Counter(module for module, file, _ in bodies if file.endswith(".txt"))
    assert all(r.violations == (bad[r.module] if r.rule == "known_extension" else 0) for r in got)
    needed = {"required_fields", "int_exact", "hole_label", "label_namespaced", "known_kind", "unquoted_literals"}
    assert all(r.failed == (r.violations > 0 or r.checked == 0 and r.rule in needed) for r in got)


def test_builtin_calls_on_odd_texts(spark, tmp_path):
    """A byte order mark at the start, an empty text and no text at all, against the SQL."""
    texts = ["\ufeffab c", "\ufeff", "", None, " ", "a\ufeff", "\x00b", "\U0001f468 x", "\u0301 y"]
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").coalesce(1).write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    cursor = con.execute(ORACLE["k_builtin_calls"])
    got = QUERIES["k_builtin_calls"](spark, str(tmp_path)).select(*[f"`{d[0]}`" for d in cursor.description]).collect()
    assert sorted(tuple(r) for r in got) == sorted(cursor.fetchall())


def test_census_of_a_missing_language(spark, small):
    """One row for the documents without a language, and no count of asserts where no code is read, against the SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small[0]}/documents.parquet/*.parquet'")
    cursor = con.execute(ORACLE["b_census"])
    got = QUERIES["b_census"](spark, small[0]).select(*[d[0] for d in cursor.description]).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(cursor.fetchall(), key=str)
