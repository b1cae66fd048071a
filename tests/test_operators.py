"""Rules on small fixtures, each good case with a bad twin."""

import json
import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.functions import names, numeric
from attestry.functions import values as V
from attestry.operators import assurance, ast_tables, conformance, graph, integrity, laws, ledger, mutation, reachability, specs
from attestry.operators.ranking import rank_in_group
from attestry.sources import corpora

NAME = lambda v: {"k": "name", "v": v}
CALL = lambda f, *a: {"k": "call", "f": f, "args": list(a)}
EXPR = lambda e: {"k": "exprS", "e": e}
RET = lambda e: {"k": "ret", "e": e}
SEQ = lambda a, b: {"k": "seq", "a": a, "b": b}


def functions(spark, *rows):
    data = [("M", n, n.split(":")[0], p, json.dumps(b), i) for i, (n, p, b) in enumerate(rows)]
    return spark.createDataFrame(data, "module STRING, name STRING, file STRING, params ARRAY<STRING>, body STRING, pos BIGINT")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dotted_tails_and_classes(spark):
    df = spark.createDataFrame([("m.py:<module>.A.clear",), ("plain",), ("ns.C.get:opt(v8.X*)",)], "n STRING")
    got = {r.n: (r.t, r.c) for r in df.select("n", names.dotted_tails(F.col("n")).alias("t"), names.class_of(F.col("n")).alias("c")).collect()}
    assert got["m.py:<module>.A.clear"] == (["py:<module>.A.clear", "A.clear", "clear"], "A")
    assert got["plain"] == ([], None)
    assert got["ns.C.get:opt(v8.X*)"][1] == "C"


def test_mangle(spark):
    df = spark.createDataFrame([("__x", "_C"), ("__x__", "C"), ("__x", "__"), ("_x", "C")], "n STRING, c STRING")
    assert [r[0] for r in df.select(names.mangle(F.col("n"), F.col("c"))).collect()] == ["_C__x", "__x__", "__x", "_x"]


def test_resolution_goldens(spark):
    table = spark.createDataFrame([("M", n) for n in ("m.py:<module>.helper", "m.py:<module>.A.clear", "m.py:<module>.B.clear", "plain")], "module STRING, name STRING")
    asked = [("helper", False), ("clear", False), ("clear", True), ("plain", False), ("lper", False), ("lper", True), ("len", False), ("len", True)]
    calls = spark.createDataFrame([("M", m, c) for c, m in asked], "module STRING, is_method BOOLEAN, callee STRING")
    want = dict(zip(asked, [True, False, True, True, False, False, True, False]))
    for resolver in (graph.resolve_calls, graph.resolve_calls_by_scan):
        assert {(r.callee, r.is_method): r.resolved for r in resolver(calls, table).collect()} == want
    c_like = spark.createDataFrame([("M", "cLike")], "module STRING, dialect STRING")
    assert not {r.callee: r.resolved for r in graph.resolve_calls(calls, table, dialects=c_like).collect() if not r.is_method}["len"]


def test_calls_and_risk_stop_at_pruned_constructs(spark):
    hidden = {"k": "tryFinally", "body": EXPR(CALL("g")), "fin": {"k": "skip"}}
    starred = EXPR(CALL("h", {"k": "starred", "a": CALL("i")}))
    indexed = {"k": "setIndex", "r": NAME("a"), "i": CALL("j"), "v": NAME("b")}
    nodes = ast_tables.flatten_ast(functions(spark, ("f", [], SEQ(hidden, SEQ(starred, indexed))))).cache()
    assert rows(ast_tables.extract_calls(nodes), "callee") == [("h",), ("j",)]
    assert rows(ast_tables.extract_calls(nodes, strict_compat=False), "callee") == [("g",), ("h",), ("i",), ("j",)]
    # h itself and the setIndex; j lies below setIndex, g and i below pruned constructs
    assert rows(ast_tables.dynamic_risk(nodes), "risk") == [(2,)]
    sizes = {c: ast_tables.node_size(nodes, c).first()["size"] for c in ("ledger", "matrix")}
    assert sizes["matrix"] - sizes["ledger"] == 2


def test_deep_bodies_survive(spark):
    depth = 30_000
    body = '{"k":"seq","a":{"k":"skip"},"b":' * depth + '{"k":"skip"}' + "}" * depth
    df = spark.createDataFrame([("M", "deep", body)], "module STRING, name STRING, body STRING")
    top = ast_tables.flatten_ast(df, ["depth", "k"]).agg(F.max("depth"), F.count("*")).first()
    assert (top[0], top[1]) == (depth + 1, 2 * depth + 1)


def test_docstrings_and_body_laws(spark):
    doc = lambda t: EXPR({"k": "str", "v": t})
    fs = functions(
        spark, ("a", ["x"], SEQ(doc("one"), SEQ(doc("two\n>>> a"), RET({"k": "int", "v": 3})))),
        ("b", [], RET({"k": "field", "a": NAME("self"), "f": "size"})), ("c", ["x"], RET({"k": "field", "a": NAME("self"), "f": "size"})),
        ("d", [], SEQ(RET({"k": "int", "v": 1}), doc("late"))),
    )
    nodes = ast_tables.flatten_ast(fs).cache()
    assert rows(ast_tables.docstrings(nodes), "fn", "doc") == [("a", "two\n>>> a")]
    assert rows(laws.body_laws(fs, nodes), "fn", "law", "detail") == [("a", "constant_body", "3"), ("b", "accessor_body", "size")]


def test_ledger_row(spark):
    fs = functions(
        spark, ("m.py:<module>.ok", [], RET(CALL("helper"))), ("m.py:<module>.helper", [], RET(NAME("x"))),
        ("m.py:<module>.bad", [], RET({"k": "hole", "label": "op:x"})), ("m.py:<module>.open", [], RET(CALL("nowhere"))),
    )
    r = ledger.coverage_ledger(fs, ast_tables.function_facts(fs)).first()
    assert (r.functions, r.holes, r.hole_free, r.verifiable_core, r.dynamic_risk, r.dialect) == (4, 1, 3, 2, 2, "python")
    assert (r.core_pct, r.holes_pct) == ("50%", "12%")


def test_classify_import(spark):
    mods = spark.createDataFrame([("pkg/a.py:<module>",), ("pkg/sub/__init__.py:<module>",)], "full_name STRING")
    fns = spark.createDataFrame([("pkg/a.py:<module>.fn",)], "full_name STRING")
    classes = spark.createDataFrame([("pkg/a.py:<module>.Cls",)], "full_name STRING")
    aliases = spark.createDataFrame([("pkg/a.py:<module>", "al")], "module_name STRING, name STRING")
    cases = {
        ("top.pkg.a", "fn", False): "function", ("pkg.a", "Cls", False): "class", ("pkg.a", "al", False): "alias", ("pkg.a", "data", False): "import:member-not-found",
        ("", "pkg.a", True): "module", ("", "os", False): "import:absent:external", (".", "a", False): "import:absent:relative",
        (".gone", "x", False): "import:absent:relative", ("__future__", "annotations", False): "unit", ("pkg.sub.deep", "x", False): "import:absent:prefix-in-cpg",
    }
    imports = spark.createDataFrame([("pkg/x.py", *c) for c in cases], "file STRING, prefix STRING, name STRING, aliased BOOLEAN")
    found = graph.classify_import(imports, mods, fns, classes, aliases)
    assert {(r.prefix, r.name, r.aliased): r.outcome for r in found.collect()} == cases
    assert graph.vocabulary_violations(found).isEmpty()


def test_numeric_goldens(spark):
    obs = [
        ("python", "%", 6, -9, "ok", -3), ("c32", "%", 6, -9, "ok", 6), ("python", "%", 7, -3, "ok", -2), ("c32", "+", 2**31 - 1, 1, "ub", None), ("java32", "+", 2**31 - 1, 1, "ok", -(2**31)),
        ("go64", "/", -(2**63), -1, "trap", None), ("c32", "%", -(2**31), -1, "ub", None), ("java32", "<<", 1, 33, "ok", 2), ("c32", "<<", 1, 33, "ub", None), ("u32", ">>>", -1 % 2**32, 31, "ok", 1),
        ("java32", ">>>", -1, 31, "ok", 1), ("python", ">>", -8, 1, "ok", -4), ("python", "/", 1, 0, "divZero", None), ("python", "cast:u8", 300, 0, "ok", 44), ("python", "cast:i8", 200, 0, "ok", -56),
        ("python", "*", 10**25, 10**25, "unrepresentable", None),
    ]
    df = spark.createDataFrame([(i, c, o, Decimal(a), Decimal(b)) for i, (c, o, a, b, _, _) in enumerate(obs)], "i INT, config STRING, op STRING, a DECIMAL(38,0), b DECIMAL(38,0)")
    got = df.join(numeric.configs(spark), "config").select("i", numeric.apply_int(F.col("op"), F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    assert [(r.r.outcome, None if r.r.value is None else int(r.r.value)) for r in got] == [(o, v) for *_, o, v in obs]


def test_int_float_comparison_is_exact_under_python(spark):
    df = spark.createDataFrame([(Decimal(10**23), 1e23), (Decimal(2**53 + 1), float(2**53)), (Decimal(5), 5.0)], "n DECIMAL(38,0), y DOUBLE")
    got = df.select(V.compare_int_float(F.col("n"), F.col("y"), F.lit(True)), V.compare_int_float(F.col("n"), F.col("y"), F.lit(False))).collect()
    assert [tuple(r) for r in got] == [(1, 0), (1, 0), (0, 0)]


def test_three_valued_comparison(spark):
    val = lambda t: ("val", t)
    cases = [val('["int",1]'), val('["int",1]'), val('["int",1]'), val('["dict",[[["str","a"],["int",1]],[["str","b"],["int",2]]]]'), ("exn", "KeyError"), val('["ref",1]'), val('["list",[["int",1]]]')]
    answers = [(1, "val", '["int",2]', None), (2, "hole", None, "x:y"), (3, "val", '["dict",[[["str","b"],["int",2]],[["str","a"],["int",1]]]]', None), (4, "exn", '["ref",3]', None), (5, "val", '["list",[]]', None), (6, "val", '["tuple",[["int",1]]]', None)]
    c = spark.createDataFrame([(i, f"f{i}", "random", v) for i, v in enumerate(cases)], "case_id BIGINT, fn STRING, origin STRING, outcome STRUCT<tag: STRING, value: STRING>")
    a = spark.createDataFrame(answers, "case_id BIGINT, tag STRING, value STRING, label STRING")
    got = {r.case_id: (r.verdict, r.reason) for r in conformance.compare_outcomes(c, a).collect()}
    assert got == {
        0: ("inconclusive", "no-answer"), 1: ("diverge", None), 2: ("inconclusive", "x:y"), 3: ("agree", None), 4: ("inconclusive", "exception-payload-unmodelled"),
        5: ("inconclusive", "representation:value-vs-object"), 6: ("diverge", None),
    }


def test_a_law_without_testimony_is_not_checked(spark):
    obs = spark.createDataFrame(
        [("f", 1, None, ['["int",1]', '["int",2]'], "[]", "[]", "val", '["int",3]', None), ("f", 2, None, ['["int",5]', '["int",6]'], "[]", "[]", "val", '["int",11]', None)],
        "fn STRING, case_id BIGINT, self STRING, args ARRAY<STRING>, heap STRING, heap_after STRING, tag STRING, value STRING, label STRING",
    )
    r = laws.refute(laws.law_commutes(obs)).first()
    assert (r.status, r.uncovered) == ("not_checked", 2)


def test_decl_ranges_cross_blocks_and_errors_find_them(spark):
    text = ["def a", "x", "x", "theorem t : True", "x", "x", "x", "x", "x", "def b"]
    lines = spark.createDataFrame([("F.lean", i + 1, t) for i, t in enumerate(text)], "file STRING, line INT, text STRING")
    decls = mutation.decl_ranges(lines, bucket=2).cache()
    assert rows(decls, "start", "end", "name") == [(1, 3, "a"), (4, 9, "t"), (10, 10, "b")]
    out = spark.createDataFrame([(1, "src/F.lean:9:2: error: no\nerror: ./F.lean:2:1: bad")], "mutant_id INT, output STRING")
    assert rows(mutation.attribute_errors(out, decls), "line", "name") == [(2, "a"), (9, "t")]


def test_mutants_use_names_of_their_own_function(spark):
    fs = functions(spark, ("f", ["p"], SEQ({"k": "assign", "x": "y", "e": NAME("q")}, RET({"k": "isOp", "neg": True, "a": NAME("p"), "b": {"k": "bool", "v": False}}))))
    ops = {r.op for r in mutation.generate_mutants(ast_tables.flatten_ast(fs), fs).collect()}
    assert {"ast-name:q->p", "ast-name:p->q", "ast-assign:y->p", "ast-polarity:true->false", "ast-bool:false->true", "ast-ret->expr", "ast-seq-delete"} <= ops


def test_spec_screen_goldens(spark):
    spec = """/- a /- nested -/ theorem no : True := by sorry -/
theorem a (x : Nat) (h : x < 0) : f x = 1 := by sorry
theorem b : ∀ (x : Nat), x = 1 → f x = f x := by sorry -- theorem c : True
theorem d : True := trivial
"""
    problems = spark.createDataFrame([("p", spec, "def f (n : Nat) : Nat := n"), ("q", "import X", "")], "problem_id STRING, spec STRING, impl STRING")
    got = {(r.problem_id, r.name): (sorted(x["check"] for x in r.findings), r.status) for r in specs.screen(specs.split_theorems(problems)).collect()}
    assert got == {
        ("p", "a"): (["unsatisfiable_hypotheses"], "flagged"), ("p", "b"): (["reflexive_conclusion"], "flagged"),
        ("p", "d"): (["dependency_vacuity", "no_sorry_obligation", "trivial_conclusion"], "flagged"), ("q", None): ([], "not_analyzed"),
    }


def test_functions_that_share_a_name(spark):
    bodies = [json.dumps(RET({"k": "hole", "label": "x"})), json.dumps(RET({"k": "int", "v": 1})), json.dumps(RET({"k": "call", "f": "nowhere"}))]
    fs = spark.createDataFrame([("m", "f", "a.py", ["p"], b, i) for i, b in enumerate(bodies)], "module STRING, name STRING, file STRING, params ARRAY<STRING>, body STRING, pos BIGINT")
    nodes = ast_tables.flatten_ast(fs)
    row = ledger.coverage_ledger(fs, ast_tables.function_facts(fs)).first()
    assert (row.functions, row.holes, row.hole_free, row.verifiable_core) == (3, 1, 2, 1)
    matrix = ledger.language_matrix(fs, ast_tables.function_facts(fs)).first()
    assert (matrix.functions, matrix.holes, matrix.hole_free) == (3, 1, 2)
    holes = ast_tables.extract_holes(nodes)
    assert [(r.occurrences, r.n_functions) for r in ledger.hole_sites(holes).collect()] == [(1, 1)]
    assert [r.pos for r in ast_tables.hole_free(fs, holes).orderBy("pos").collect()] == [1, 2]


def test_spec_screen_has_no_caps(spark):
    blocks = " ".join(f"∀ (x{k} : Nat)," for k in range(20))
    texts = [
        f"theorem deep : {blocks} True := by sorry",
        "theorem range (x : Nat) (h : 2000000000 < x) (k : x < 3000000000) : f x = 1 := by sorry",
        "theorem none (x : Nat) (h : 2000000000 < x) (k : x < 2000000001) : f x = 1 := by sorry",
    ]
    problems = spark.createDataFrame([("same", t, "def f (n : Nat) : Nat := n", "r", True, None) for t in texts], "problem_id STRING, spec STRING, impl STRING, repo STRING, is_canonical BOOLEAN, claims_invokes_impl BOOLEAN")
    screened = specs.screen(specs.split_theorems(problems))
    got = {r.name: sorted(x["check"] for x in r.findings) for r in screened.collect()}
    assert got == {"deep": ["dependency_vacuity", "trivial_conclusion"], "range": [], "none": ["unsatisfiable_hypotheses"]}
    statuses = specs.problem_status(screened)
    assert sorted((r.theorems_found, r.status) for r in statuses.collect()) == [(1, "clean_static"), (1, "flagged"), (1, "flagged")]
    assert specs.screen_summary(statuses).first().problems_analyzed == 3


def test_escapes_in_comments_and_strings_do_not_count(spark):
    text = 'def a := "sorry"\n-- sorry\n/- sorry /- sorry -/ sorry -/ theorem t := by sorry\n\naxiom x : Nat\n'
    found = specs.escape_sweep(spark.createDataFrame([("a.lean", text)], "path STRING, text STRING"))
    assert rows(found, "kind", "line") == [("axiom", 4), ("sorry", 3)]


def test_empty_contract_is_a_failure(spark):
    nothing = functions(spark, ("f", [], RET(NAME("x")))).where("false")
    contract = integrity.nothing_checked(spark, integrity.validate_contract(nothing, ast_tables.flatten_ast(nothing)))
    assert rows(contract, "rule", "failed") == [("corpus_present", True)]


def test_contract_violations(spark):
    fs = functions(spark, ("f", [], SEQ(RET({"k": "int", "v": 2**60}), RET({"k": "hole", "label": "bare"}))), ("g", [], RET({"k": "int", "v": str(2**60)})))
    got = {r.rule: (r.checked, r.violations, r.failed) for r in integrity.validate_contract(fs, ast_tables.flatten_ast(fs)).collect()}
    assert got["int_exact"] == (2, 1, True) and got["label_namespaced"] == (1, 1, True) and got["hole_label"] == (1, 0, False)


def test_support_never_exceeds_coverage(spark):
    cases = [("SUPPORTED", 10, 10, "SUPPORTED"), ("SUPPORTED", 8, 10, "WEAK"), ("SUPPORTED", 7, 10, "UNSUPPORTED"), ("DEFEATED", 10, 10, "DEFEATED"), ("WEAK", 0, 0, "WEAK")]
    df = spark.createDataFrame(cases, "s STRING, c INT, p INT, want STRING")
    assert all(r[0] == r[1] for r in df.select(assurance.coverage_cap(F.col("s"), F.col("c"), F.col("p")), "want").collect())


def test_read_functions_and_errors(spark, tmp_path):
    (tmp_path / "ast-A.json").write_text(json.dumps([{"name": "f", "file": "a.py", "params": ["x"], "body": RET({"k": "int", "v": "9007199254740993"})}]))
    (tmp_path / "ast-B.json").write_text("[]")
    (tmp_path / "ast-C.json").write_text('{"name": "g"}')
    glob = f"{tmp_path}/ast-*.json"
    one = corpora.read_functions(spark, glob).where("module = 'A'").first()
    assert json.loads(one.body)["e"]["v"] == "9007199254740993" and one.params == ["x"]
    assert sorted(r.error for r in corpora.corpus_errors(spark, glob).collect()) == ["empty corpus", "not an array"]


def test_read_problems(spark, tmp_path):
    lines = ['{"sample_id": "1", "spec": "theorem", "is_canonical": false}', '{"id": "2", "Spec.lean": "theorem", "is_canonical": true}', '{"sample_id": "3", "spec": ""}', "{broken"]
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(lines))
    assert rows(corpora.read_problems(spark, str(path)), "problem_id") == [("1",), ("2",)]
    assert rows(corpora.read_problems(spark, str(path), limit=1, canonical_only=True), "problem_id") == [("2",)]
    assert rows(corpora.bad_problem_lines(spark, str(path)), "line") == [("{broken",)]


def test_evidence_unreadable_is_missing(spark, tmp_path):
    (tmp_path / "ledger-M.json").write_text('{"module": "M"}')
    (tmp_path / "mutation.json").write_text("{oops")
    got = {r.kind: (r.present, r.subject_module) for r in corpora.read_evidence(spark, str(tmp_path), ["M"]).collect()}
    assert len(got) == 9 and got["ledger"] == (True, "M") and got["mutation"] == (False, None)


def test_corpus_diff_counts_copies(spark):
    schema = "module STRING, name STRING, body STRING"
    a = spark.createDataFrame([("M", "same", "1"), ("M", "same", "1"), ("M", "fewer", "1"), ("M", "fewer", "1"), ("M", "gone", "1"), ("M", "edited", "1")], schema)
    b = spark.createDataFrame([("M", "same", "1"), ("M", "same", "1"), ("M", "fewer", "1"), ("M", "new", "1"), ("M", "edited", "2")], schema)
    got = dict(rows(integrity.diff_corpora(a, b), "name", "change"))
    assert got == {"same": "same", "fewer": "body_differs", "gone": "only_first", "new": "only_second", "edited": "body_differs"}


def test_reach_follows_cycles_to_a_fixpoint(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "src STRING, dst STRING")
    reached = reachability.Reach(edges, spark.createDataFrame([("a",), ("d",)], "root STRING"))
    assert rows(reached.expanded(), "root", "decl") == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e")]
    claims = spark.createDataFrame([("a", "c"), ("a", "e")], "root STRING, impl STRING")
    assert rows(reachability.depends_on(reached, claims), "impl", "status") == [("c", "DEPENDS"), ("e", "VACUOUS")]
    found = reachability.declaration_evidence(reached, spark.createDataFrame([("c",), ("e",), ("z",)], "axiom STRING"), ["e"])
    assert rows(found, "root", "dep_count", "axioms", "clean") == [("a", 3, ["c"], True), ("d", 2, ["e"], False)]


def test_provenance_with_nothing_to_check_is_not_a_pass(spark):
    artifacts = spark.createDataFrame([], "artifact STRING, sha256 STRING")
    records = spark.createDataFrame([], "artifact STRING, artifact_sha256 STRING, parser_version STRING, exporter STRING, exporter_sha256 STRING, source_path STRING, source_revision STRING, command STRING, schema_version INT, unreadable BOOLEAN, recorded_artifact STRING")
    baseline = spark.createDataFrame([], "artifact STRING, artifact_sha256 STRING, reason STRING")
    exporters = spark.createDataFrame([], "exporter STRING, sha256 STRING")
    audited = integrity.audit_provenance(artifacts, records, baseline, exporters, "v1")
    assert integrity.provenance_summary(audited).first()["outcome"] == "NOTHING_CHECKED"


def closure(edges, root):
    seen, todo = {root}, [root]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(4))
def test_reach_by_condensation(spark, seed):
    """Cycles in and behind one another, tails before and behind them, loops, repeated edges and null ends."""
    rnd = random.Random(seed)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(rnd.choice([25, 35, 60]))] + [(100 + i, 101 + i) for i in range(9)] + [(109, rnd.randrange(30)), (5, 5), (None, 3), (4, None)]
    edges += [(200 + i, 200 + (i + 1) % 11) for i in range(11)] + [(rnd.randrange(30), 204), (205, 300), (300, 301), *edges[:5]]
    roots = [(r,) for r in [100, 100, 203, 300, 999, None, *range(0, 30, 4)]]
    reached = reachability.Reach(spark.createDataFrame(edges, "src INT, dst INT"), spark.createDataFrame(roots, "root INT"))
    want = {r: closure([e for e in edges if None not in e], r) for (r,) in roots if r is not None}
    assert rows(reached.expanded(), "root", "decl") == sorted((r, d) for r, found in want.items() for d in found)
    summed = reached.summed(n=lambda node: F.lit(1), total=lambda node: node)
    assert rows(summed, "root", "n", "total") == sorted((r, len(f), sum(f)) for r, f in want.items())
    claims = [(r, impl) for r in want for impl in (0, 7, 204, 301, 999)]
    got = reachability.depends_on(reached, spark.createDataFrame(claims, "root INT, impl INT"))
    assert rows(got, "root", "impl", "status") == sorted((r, i, "DEPENDS" if i in want[r] else "VACUOUS") for r, i in claims)


def test_mutation_scores_by_complement(spark):
    """Counts from hits and declarations against the verdict of every mutant and theorem; one theorem named by nearly all mutants."""
    rnd = random.Random(7)
    runs = [(i, rnd.choice([0, 1, 1, 1]), rnd.random() < 0.1) for i in range(80)]
    errors = []
    for i, rc, _ in runs:
        for _ in range(rnd.choice([0, 1, 1, 2]) if rc else 0):
            errors.append((i, *rnd.choice([("prog", "def", "d"), ("prog", None, None), ("spec", "theorem", "hot"), ("spec", "theorem", "hot"), ("spec", "lemma", "b"), ("spec", "def", "x"), ("other", None, None)])))
    mutants = [(i, f"d{i % 3}") for i, *_ in runs]
    targets, subjects = ["hot", "b", "c", "own", "none"], [("own", "d1"), ("own", "d1"), ("b", "d0"), ("b", "d2"), ("none", "gone")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    judged, hits = mutation.judge_mutants(df(runs, "mutant_id INT, rc INT, timed_out BOOLEAN"), df(errors, "mutant_id INT, file STRING, kind STRING, name STRING"), "prog", "spec")
    mutant_df, subject_df = df(mutants, "mutant_id INT, decl STRING"), df(subjects, "theorem STRING, decl STRING")
    asked = df([(i, t) for i, *_ in runs for t in targets], "mutant_id INT, theorem STRING")
    verdicts = {(r.mutant_id, r.theorem): r.verdict for r in mutation.classify_mutants(judged, hits, asked).collect()}
    assert len(verdicts) == 400 and set(verdicts.values()) == {"killed", "survived", "invalid", "inconclusive"}
    want = []
    for t in targets:
        decls = {d for s, d in subjects if s == t}
        own = [verdicts[i, t] for i, d in mutants if not decls or d in decls]
        killed, survived = own.count("killed"), own.count("survived")
        score = killed / (killed + survived) if killed + survived else 0.0
        verdict = "UNTESTED" if decls and not killed + survived else "HAS TEETH" if score == 1 else "WEAK" if score else "VACUOUS"
        every = [verdicts[i, t] for i, _ in mutants]
        want.append((t, killed, survived, round(score, 9), round(every.count("killed") / (every.count("killed") + every.count("survived")), 9), verdict))
    got = mutation.mutation_score(judged, hits, mutant_df, df([(t,) for t in targets], "theorem STRING"), subject_df).collect()
    assert sorted((r.theorem, r.killed, r.survived, round(r.score, 9), round(r.coverage_score, 9), r.verdict) for r in got) == sorted(want)
    alive = mutation.survivors_on_subject(judged, hits, mutant_df, subject_df)
    assert rows(alive, "theorem", "mutant_id") == sorted((t, i) for t, d in set(subjects) for i, e in mutants if d == e and verdicts[i, t] == "survived")
    nobody = mutation.mutation_score(judged.limit(0), hits.limit(0), mutant_df, df([("a",)], "theorem STRING"), subject_df).collect()
    assert [(r.theorem, r.killed, r.survived, r.score, r.verdict) for r in nobody] == [("a", 0, 0, 0.0, "VACUOUS")]


def test_ranks_of_a_hot_group(spark):
    """One group with most rows goes over all tasks, others and null keys stand between and inside partitions."""
    made = [("hot", i) for i in range(3000)] + [(k, i) for k in ("a", "z", None) for i in range(40)] + [(f"k{i}", 5) for i in range(50)]
    random.Random(2).shuffle(made)
    df = spark.createDataFrame(made, "k STRING, pos INT").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_in_group(df, ["k"], ["pos"])
        assert ranked.where("k = 'hot'").agg(F.max("rank")).first()[0] == 2999
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r.k, r.pos): r["rank"] for r in ranked.collect()} == {(k, p): 0 if p == 5 and (k or "").startswith("k") else p for k, p in made}
    fs = df.where("k IS NOT NULL").select(F.lit("m").alias("module"), F.concat("k", F.lit("!")).alias("name"), (F.col("pos") + F.crc32("k")).alias("pos"))
    idents = graph.unique_ident(fs).collect()
    assert len({r.ident for r in idents}) == len(idents) == 3130


def test_links_of_a_claim_in_blocks(spark):
    links = spark.createDataFrame([("m", f"e{i:04}", "c", "SUPPORTS") for i in range(1000)] * 2 + [("m", "x", "c", "COUNTERS"), ("m", "e0001", "c", "COUNTERS"), ("m", "y", "c", "SUPPORTS")], "module STRING, source STRING, target STRING, type STRING")
    evidence = spark.createDataFrame([("m", f"e{i:04}") for i in range(1000)], "module STRING, id STRING")
    blocks = assurance.argument_edges(evidence, links, size=64).collect()
    assert max(len(r.sources) for r in blocks) == 64 and sorted(r.block for r in blocks if r.kind == "evidence") == list(range(16))
    assert [s for r in sorted(blocks, key=lambda r: r.block) if r.kind == "evidence" for s in r.sources] == [f"e{i:04}" for i in range(1000)]
    claims = assurance.argument_claims(spark.createDataFrame([("m", "c", "DEFEATED"), ("m", "d", "UNDEVELOPED")], "module STRING, id STRING, status STRING"), evidence, links)
    assert rows(claims, "id", "evidence", "counter_evidence", "defeaters", "undeveloped", "defeated") == [("c", 1000, 1, 1, False, True), ("d", 0, 0, 0, True, False)]


def test_facts_and_kinds_of_the_walk_are_those_of_the_node_table(spark):
    rnd = random.Random(11)

    def expr(depth):
        k = rnd.choice(["name", "call", "mcall", "hole", "binop", "listE", "closure", "str"] if depth else ["name", "hole"])
        inner = [expr(depth - 1) for _ in range(rnd.randrange(3))] if depth else []
        return {"k": k, "v": "x", "f": rnd.choice("fg"), "m": "m", "label": "l", "args": inner, "a": expr(depth - 1) if depth and rnd.random() < 0.5 else None}

    bodies = [SEQ({"k": rnd.choice(["setIndex", "exprS", "tryFinally", "ret"]), "e": expr(4), "body": expr(3)}, RET(expr(2))) for _ in range(60)] + [{"nokind": 1, "v": {"k": "holeS"}}, SEQ({"k": "skip"}, {"k": "skip"})]
    fs = functions(spark, *[(f"f{i}", ["p"], b) for i, b in enumerate(bodies)])
    nodes, facts = ast_tables.flatten_ast(fs), ast_tables.function_facts(fs)
    columns = ["fn", "ledger_nodes", "matrix_nodes", "shape_nodes", "holes", "risk", "max_depth"]
    assert rows(facts, *columns) == rows(ast_tables.fn_stats(nodes), *columns)
    called = ["fn", "is_method", "callee"]
    assert rows(ast_tables.calls_of(facts), *called) == rows(ast_tables.extract_calls(nodes).distinct(), *called)
    key = ["fn", "node_id", "label", "kind"]
    assert rows(ast_tables.holes_of(fs), *key) == rows(ast_tables.extract_holes(nodes), *key)
    hidden = spark.createDataFrame([("M", "f", "f", ["p"], '{"k": "h\\u006fle", "label": "x"}', 0)], fs.schema)
    assert [r.label for r in ast_tables.holes_of(hidden).collect()] == ["x"]


@pytest.mark.parametrize("seed", range(3))
def test_free_names_and_captures_by_walking_up(spark, seed):
    """Scopes up to five deep, some missing in between, names that are prefixes of each other; one name used and bound everywhere."""
    rnd = random.Random(seed)
    scopes = {f"m{m}.py:<module>" for m in range(3)}
    for _ in range(60):
        scopes.add(rnd.choice(sorted(scopes)) + "." + rnd.choice(["f", "ff", "f-", "g", "<lambda>"]))
    gone = set(rnd.sample(sorted(s for s in scopes if s.count(".") > 1), 5))
    kept = sorted(scopes - gone)
    uses = [(s, x) for s in kept for x in rnd.sample("abcde", 2) + ["self"]] * 2
    binds = [(s, x) for s in sorted(scopes) for x in "abcde" if rnd.random() < 0.15] + [(s, "self") for s in kept[::3]]
    bound, known, up = set(binds), set(kept), lambda s: s.rpartition(".")[0]
    free = set()
    for s, x in uses:
        while s in known and (s, x) not in bound:
            free.add((s, x))
            s = up(s)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    methods = df([(s, s.split(".")[-1]) for s in kept], "full_name STRING, name STRING")
    bind_df = df(binds, "full_name STRING, ident STRING")
    got = graph.free_names(methods, df(uses, "full_name STRING, ident STRING"), bind_df)
    assert rows(got, "full_name", "ident") == sorted(free)

    def captured(s, x):
        s = up(s)
        while s:
            if s in known and not s.split(".")[-1].startswith("<") and (s, x) in bound:
                return True
            s = up(s)
        return False

    closures = graph.captures(methods, got, bind_df)
    assert rows(closures, "full_name", "is_closure") == [(s, any(captured(f, x) for f, x in free if f == s)) for s in kept]


def test_batches_of_the_screening_are_bounded(spark):
    """What a worker holds at once is bounded in rows and bytes: 20,000 short problems, and 64 of a megabyte."""
    text = "-- é\n/- /- b -/ -/ y"
    held = F.arrow_udf(lambda c: pa.array([len(c)] * len(c), pa.int64()), "bigint")
    most = lambda df: df.select(held("spec").alias("n")).agg(F.max("n")).first()[0]
    assert most(spark.range(0, 20_000, 1, 1).select(F.concat(F.lit(text), "id").alias("spec"))) <= 1_000
    long = spark.range(0, 64, 1, 1).select(F.repeat(F.lit(text + "\n"), 50_000).alias("spec"))
    assert most(long) <= 16
    assert {r.bare for r in long.select(specs.without_comments("spec").alias("bare")).collect()} == {"\n y\n" * 50_000}


def test_short_operands_agree_with_decimal_ones(spark):
    """Every configuration and operation at the edges of 32 and 64 bits; most rows take the 64-bit way, and give what DECIMAL gives."""
    edges = [0, 1, -1, 2, -7, 31, 32, 63, 64, 68, 2**31 - 1, -(2**31), 2**31, -(2**31) - 1, numeric.SHORT, -numeric.SHORT, numeric.SHORT + 1, 2**63 - 1, -(2**63), 2**70, None]
    ops = ["+", "-", "*", "/", "//", "%", "&", "|", "^", "<<", ">>", ">>>", "neg", "~"]
    cells = spark.createDataFrame([(None if x is None else Decimal(x),) for x in edges], "a decimal(38,0)")
    cells = cells.crossJoin(cells.withColumnRenamed("a", "b")).crossJoin(numeric.configs(spark)).withColumn("op", F.explode(F.array(*map(F.lit, ops))))
    found = numeric.apply_rows(cells, ops).select("config", "op", "a", "b", "outcome", F.coalesce(F.col("short").cast(numeric.INT), "wide").alias("v"), F.col("short").isNotNull().alias("quick"))
    wanted = cells.select("config", "op", "a", "b", numeric.apply_int(F.col("op"), F.col("a"), F.col("b"), only=ops).alias("r")).select("config", "op", "a", "b", "r.outcome", F.col("r.value").alias("v"))
    key = lambda r: tuple(str(r[c]) for c in ("config", "op", "a", "b", "outcome", "v"))
    got = found.collect()
    assert sorted(map(key, got)) == sorted(map(key, wanted.collect())) and sum(r.quick for r in got) > len(got) / 4


def test_closures_in_one_pass(spark):
    """The same as captures of the free names, but binders are sorted once; before, they were twice."""
    rnd = random.Random(4)
    scopes = ["m:<module>", *[f"m:<module>.f{i}" for i in range(3)], *[f"m:<module>.f{i}.g{j}" for i in range(3) for j in range(2)], "m:<module>.f0.g0.h", "m:<module>.f1.<lambda>.k", "m:<module>.f1.<lambda>", "m:<module>.q.r.s"]
    methods = spark.createDataFrame([(x, x.split(".")[-1] if "." in x else "<module>") for x in scopes], "full_name string, name string")
    row = lambda n: spark.createDataFrame([(rnd.choice([*scopes, "m:<module>.f1.g1.x.y"]), rnd.choice("abc")) for _ in range(n)], "full_name string, ident string")
    closed = 0
    for _ in range(3):
        uses, binds = row(20), row(9)
        got = graph.closures(methods, uses, binds)
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, graph.captures(methods, graph.free_names(methods, uses, binds), binds).collect()))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
        closed += sum(x[1] for x in rows)
    assert closed > 0
