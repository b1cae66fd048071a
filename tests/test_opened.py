"""Bodies opened together give what the walk gives, and queries open them once."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from attestry.operators import ast_tables, mutation
from attestry.plans import corpus
from attestry.plans.registry import QUERIES

DEEP = '{"k":"seq","a":{"k":"skip"},"b":' * 300 + '{"k":"call","f":"deep"}' + "}" * 300
BODIES = [
    '{"k":"call","f":"plain","args":[{"k":"mcall","m":"m","recv":{"k":"name","v":"self"}},{"k":"hole","label":"len:20"}]}',
    '{"k":"call","f":"a\\"{b","args":[]}', '{"k":"call","f":"in,}{ner","args":[]}', '{"x":{"k":"call","f":"in"},"k":"call","f":"out","k":"mcall","m":"last"}',
    json.dumps({"k": "seq", "a": {"k": "call", "f": None, "args": [{"k": "int", "v": -3}]}, "b": {"v": 1}}), json.dumps({"k": "call", "f": "spread"}, indent=1),
    '{"a":{"x":[{"k":"kwargE","n":"q","e":{"k":"mcall","m":"zz","recv":{"k":"name","v":"self"}}}]},"k":"setIndex","v":{"k":"field","f":"é","a":{"k":"int","v":7}}}',
    '[{"k":"call","f":"listed"}]', "{}", '{"k":3}', '{"args":[{"f":"y","k":"call"},[{"k":"hole"}]],"k":"call","f":7}', DEEP,
    '{"k":"seq","a":{"k":"exprS","e":{"k":"str","v":"doc"}},"b":{"k":"raise","e":{"k":"float","v":1.5}}}', '{"k":"bool","v":true}', '{"k":"isOp","neg":true,"a":{"k":"binop","op":"+"}}', '{"k":"binop","op":"-","a":{"k":"unit"},"v":{"k":"int","v":10}}', '{"k":"int","v":0}',
]


def test_facts_together_are_those_of_the_walk():
    got = zip(*ast_tables._facts_together(pa.array(BODIES)))
    text = lambda c: c.decode() if type(c) is bytes else c
    plain = lambda facts: [*facts[:6], sorted(((c["is_method"], text(c["callee"])) for c in facts[6]), key=str)]
    assert [plain(f) for f in got] == [plain(ast_tables._facts(ast_tables._decode(b))) for b in BODIES]


def test_both_closures_open_each_body_once(spark, monkeypatch):
    opened = []
    facts = ast_tables.function_facts
    monkeypatch.setattr(ast_tables, "function_facts", lambda functions: opened.append(1) or facts(functions))
    assert QUERIES["c_closure_agrees"](spark, "/root/testdata/sf0.001").count() == 0
    assert len(opened) == 1


def test_nodes_together_are_those_of_the_walk():
    columns = ["node_id", "k", "op", "name", "label", "v", "v_type", "under_pruned", "under_set_index", "is_doc"]
    bodies = [b for b in BODIES if b != '{"k":3}']  # a kind that is a number is refused by the walk
    n = len(bodies)
    batch = pa.RecordBatch.from_arrays([pa.array(["m"] * n), pa.array([f"f{i}" for i in range(n)]), pa.array(range(n)), pa.array(bodies)], names=[*ast_tables.KEY, "body"])
    for kinds in (None, frozenset(["call", "mcall"])):
        got = [tuple(r.values()) for b in ast_tables._flatten_batches(columns, kinds)([batch]) for r in b.to_pylist()]
        at = [ast_tables._WALK_COLUMNS.index(c) for c in columns]
        want = [("m", f"f{i}", i, *(row[j] for j in at)) for i, b in enumerate(bodies) for row in ast_tables._walk(ast_tables._decode(b), kinds)]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert len(list(ast_tables._nodes_together(batch, columns, kinds)[1].nonzero()[0])) < n // 2 + 1


def test_boundary_attempts_stay_in_the_row_of_their_function(spark):
    from attestry.operators import laws

    found = laws.boundary_domain(spark.createDataFrame([("f:int(int, bool)", 2), ("f:int(int, bool)", 2), ("g", 1)], "fn string, n_params int"))
    assert found.groupBy("fn").count().where("count = 8").count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Generate") < plan.index("Aggregate")


def test_bodies_are_those_of_their_texts_and_made_once(spark, tmp_path):
    texts = [
        "", None, " ", "\n", "\n\n a\n", "to be or not", "x" * 19 + " " + "y" * 18 + "\u00e9", "dddd  eeeeee\nsix six six six six", "\u65e5\u672c\u8a9e a\tb\r \u00e9\u00e9\u00e9\u00e9\u00e9\u00e9!",
        'q"uo\\te {br}ace a_b-c', "a bb ccc dddd eeeee ffffff ggggggg", "z", "\ufeffseven- sevens7",
    ]

    def word(w):
        n, i = len(w), "".join(c for c in w if c.isascii() and (c.isalnum() or c == "_"))
        name, own = (lambda x: {"k": "name", "v": x}), {"k": "name", "v": "self"}
        if n >= corpus.HOLE_LENGTH:
            return {"k": "hole", "label": f"len:{n}"}
        return [
            {"k": "call", "f": i, "args": [name(i)]}, name(i), {"k": "str", "v": i}, {"k": "int", "v": n}, {"k": "mcall", "recv": own, "m": i, "args": []},
            {"k": "field", "a": own, "f": i}, {"k": "binop", "op": "+", "a": name(i), "b": {"k": "int", "v": n}},
        ][n % 7]

    def line(ws):
        listed, m = (lambda k: {"k": k, "items": [word(w) for w in ws]}), len(ws)
        if not ws:
            return {"k": "skip"}
        return [
            {"k": "exprS", "e": listed("listE")}, {"k": "assign", "x": "l", "e": listed("listE")}, {"k": "ret", "e": listed("tupleE")},
            {"k": "tryFinally", "body": {"k": "exprS", "e": listed("listE")}, "fin": {"k": "skip"}}, {"k": "setIndex", "r": {"k": "name", "v": "self"}, "i": listed("listE"), "v": {"k": "int", "v": m}},
        ][m % 5]

    def body(text):
        found = {"k": "skip"}
        for ws in reversed([[w for w in x.split(" ") if w] for x in text.split("\n")]):
            found = {"k": "seq", "a": line(ws), "b": found}
        return json.dumps(found, separators=(",", ":"))

    want = [None if t is None else body(t) for t in texts]
    sliced = pa.array(["before"] + texts).slice(1)
    assert corpus._bodies_together(sliced).to_pylist() == want == [b for a in corpus._bodies(iter([sliced, pa.array([], pa.string())])) for b in a.to_pylist()]
    rows = [(i, t, "en", "web", 0) for i, t in enumerate([*texts, "------- \u00e9\u00e9\u00e9\u00e9\u00e9\u00e9 dddd seven.\U0001f468", "a" * 70_000 + " b"])]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{tmp_path}/documents.parquet")
    made = corpus.functions(spark, str(tmp_path)).orderBy("pos").collect()
    firsts = [next((i for w in (t or "").replace("\n", " ").split(" ") if len(w) % 7 == 0 and (i := "".join(c for c in w if c.isascii() and (c.isalnum() or c == "_")))), "f") for _, t, *_ in rows]
    assert [f.name.rsplit(".", 1)[1] for f in made] == firsts and [f.body for f in made[:-2]] == want
    plan = corpus.nodes(spark, "/root/testdata/sf0.001", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") + plan.count("_bodies(text") == 1


def test_census_facts_are_those_of_the_walk():
    doc = lambda v: {"k": "exprS", "e": {"k": "str", "v": v}}
    documented = {"k": "seq", "a": doc("one"), "b": {"k": "seq", "a": doc(">>> two"), "b": {"k": "raise", "e": {"k": "raise"}}}}
    bodies = [b for b in BODIES if b != '{"k":3}'] + [json.dumps(documented), '{"a":{"e":{"v":"last","k":"str"},"k":"exprS"},"k":"seq"}', '{"k":"raise"}']
    raises, docs = (c.to_pylist() for c in ast_tables._census_together(pa.array(bodies)))
    k, v, is_doc = (ast_tables._WALK_COLUMNS.index(c) for c in ("k", "v", "is_doc"))
    for body, n, found in zip(bodies, raises, docs, strict=True):
        nodes = list(ast_tables._walk(ast_tables._decode(body)))
        assert (n, found) == (sum(x[k] == "raise" for x in nodes), [None, *(x[v] for x in nodes if x[is_doc])][-1])
    assert raises[-3:] == [2, 0, 1] and docs[-3:] == [">>> two", "last", None]


def test_census_and_mutants_are_counted_where_bodies_are_opened(spark):
    for name in ("b_census", "g_generate_mutants"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_mutants_of_alike_nodes_are_all_mutants(spark):
    named = [
        '{"k":"assign","x":"a","e":{"k":"name","v":"a"}}', '{"k":"assign","x":"p","e":{"k":"name","v":"p"}}', '{"k":"name"}', '{"k":"seq","a":{"k":"name"},"b":{"k":"name","v":"z"}}', '{"k":"del","x":"y"}',
        '{"k":"seq","a":{"k":"int","v":"12"},"b":{"k":"int","v":"1x"}}', '{"k":"int","v":-4}', '{"k":"unop","op":"!","e":{"k":"bool","v":true}}', '{"k":"setField","r":{"k":"name","v":"q"},"f":"g"}', '{"k":"raise"}', None,
    ]
    bodies = [b for b in BODIES if b != '{"k":3}'] + named
    rows = [(m, f"f{i}", params, body, i) for i, body in enumerate(bodies) for m, params in (("none", []), ("one", ["p"]), ("two", ["p", "q"]), (None, None))]
    functions = spark.createDataFrame(rows, "module STRING, name STRING, params ARRAY<STRING>, body STRING, pos BIGINT")
    made = mutation.generate_mutants(ast_tables.flatten_ast(functions), functions).select("module", F.split("op", ":").getItem(0).alias("family"))
    want = {(r.module, r.family): r["count"] for r in made.groupBy("module", "family").count().collect()}
    assert {(r.module, r.family): r.n for r in mutation.count_mutants(functions).collect()} == want
    assert {f for _, f in want} >= {"ast-name", "ast-assign", "ast-int", "ast-unop", "ast-polarity", "ast-bool", "ast-setfield", "ast-seq-delete"}
