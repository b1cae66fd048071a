"""AST tables, call resolution and ledgers over the corpus that Spark derives from `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import names
from attestry.operators import ast_tables, graph, ledger
from attestry.plans import corpus
from attestry.plans.corpus import HOLE_LENGTH, WITH_FUNCS, WITH_LINES, WITH_WORDS
from attestry.plans.registry import query, table
from attestry.session import stored

_HOLE = f"n >= {HOLE_LENGTH}"
_WORD_KIND = f"""CASE WHEN {_HOLE} THEN 'hole' WHEN n % 7 = 0 THEN 'call' WHEN n % 7 = 1 THEN 'name'
  WHEN n % 7 = 2 THEN 'str' WHEN n % 7 = 3 THEN 'int' WHEN n % 7 = 4 THEN 'mcall' WHEN n % 7 = 5 THEN 'field'
  ELSE 'binop' END"""
_WORD_NODES = f"CASE WHEN {_HOLE} OR n % 7 IN (1, 2, 3) THEN 1 WHEN n % 7 = 6 THEN 3 ELSE 2 END"
_SEEN = "m % 5 <> 3"  # not below tryFinally
_RISKY = f"NOT ({_HOLE}) AND n % 7 IN (0, 4, 5, 6) AND m % 5 NOT IN (3, 4)"

# Per function: both node counts, holes, risk, deepest level.
WITH_STATS = (
    WITH_FUNCS
    + f""",
  wagg AS (
    SELECT doc_id, i, sum({_WORD_NODES}) AS wn, count(*) FILTER ({_HOLE}) AS holes, count(*) FILTER ({_RISKY}) AS risk,
           max(CASE WHEN {_HOLE} OR n % 7 IN (1, 2, 3) THEN 0 ELSE 1 END) AS deep
    FROM words GROUP BY ALL
  ),
  lagg AS (
    SELECT l.doc_id, l.i, len(l.ws) AS m,
           CASE WHEN len(l.ws) = 0 THEN 1 WHEN len(l.ws) % 5 IN (3, 4) THEN 4 ELSE 2 END AS base,
           coalesce(w.wn, 0) AS wn, coalesce(w.holes, 0) AS holes, coalesce(w.risk, 0) AS risk,
           CASE WHEN len(l.ws) = 0 THEN l.i + 2 WHEN len(l.ws) % 5 = 3 THEN l.i + 5 + w.deep ELSE l.i + 4 + w.deep END AS depth
    FROM lines l LEFT JOIN wagg w USING (doc_id, i)
  ),
  stats AS (
    SELECT doc_id, CAST(sum(base + wn) + 1 AS BIGINT) AS ledger_nodes,
           CAST(sum(base + wn) + 1 + count(*) AS BIGINT) AS matrix_nodes,
           CAST(sum(holes) AS BIGINT) AS holes,
           CAST(sum(risk) + count(*) FILTER (m > 0 AND m % 5 = 4) AS BIGINT) AS risk,
           CAST(greatest(max(depth), count(*) + 1) AS BIGINT) AS max_depth
    FROM lagg GROUP BY doc_id
  )"""
)
_WITH_CALLS = (
    WITH_FUNCS
    + f""",
  calls AS (
    SELECT f.module, f.name AS fn, n % 7 = 4 AS is_method, id AS callee
    FROM words w JOIN funcs f USING (doc_id) WHERE NOT ({_HOLE}) AND n % 7 IN (0, 4) AND {_SEEN}
  )"""
)
# Names as they may be called: full names, and what follows each of their dots.
_WITH_INDEX = (
    _WITH_CALLS
    + """,
  parts AS (SELECT module, name, string_split(name, '.') AS ps FROM funcs),
  tails AS (
    SELECT module, name, array_to_string(list_slice(ps, s, len(ps)), '.') AS tail
    FROM (SELECT *, unnest(range(2, len(ps) + 1)) AS s FROM parts)
  ),
  tail_count AS (SELECT module, tail, count(*) AS c FROM tails GROUP BY ALL),
  callees AS (SELECT DISTINCT module, is_method, callee FROM calls)"""
)
_BUILTINS = ", ".join(f"'{n}'" for n in rules.BUILTIN_FREE_NAMES)
_WITH_RESOLVED = (
    _WITH_INDEX
    + f""",
  resolved AS (
    SELECT c.module, c.is_method, c.callee,
           CASE WHEN is_method THEN coalesce(t.c, 0) >= 1
                ELSE f.name IS NOT NULL OR coalesce(t.c, 0) = 1 OR c.callee IN ({_BUILTINS}) END AS resolved
    FROM callees c LEFT JOIN tail_count t ON t.module = c.module AND t.tail = c.callee
    LEFT JOIN (SELECT DISTINCT module, name FROM funcs) f ON f.module = c.module AND f.name = c.callee
  )"""
)
_DIALECT = """CASE WHEN ext_py >= ext_c THEN 'python' ELSE 'cLike' END"""


def _counted(spark, sf):
    functions = corpus.functions(spark, sf)
    return functions, ast_tables.function_facts(functions)


@query(
    "b_node_kinds",
    f"""WITH {WITH_WORDS}, kinds AS (
      SELECT module, {_WORD_KIND} AS k FROM words
      UNION ALL SELECT module, 'name' FROM words WHERE NOT ({_HOLE}) AND n % 7 IN (0, 4, 5, 6)
      UNION ALL SELECT module, 'int' FROM words WHERE NOT ({_HOLE}) AND n % 7 = 6
      UNION ALL SELECT module, 'seq' FROM lines
      UNION ALL SELECT lang, 'skip' FROM documents
      UNION ALL SELECT module, unnest(CASE WHEN len(ws) = 0 THEN ['skip'] WHEN len(ws) % 5 = 0 THEN ['exprS', 'listE']
        WHEN len(ws) % 5 = 1 THEN ['assign', 'listE'] WHEN len(ws) % 5 = 2 THEN ['ret', 'tupleE']
        WHEN len(ws) % 5 = 3 THEN ['tryFinally', 'exprS', 'listE', 'skip'] ELSE ['setIndex', 'name', 'listE', 'int'] END)
      FROM lines)
    SELECT module, k, count(*) AS n FROM kinds GROUP BY ALL""",
)
def node_kinds(spark, sf):
    return corpus.nodes(spark, sf, ["k"]).groupBy("module", "k").agg(F.count("*").alias("n"))


@query(
    "b_holes",
    f"""WITH {WITH_FUNCS}
    SELECT f.module, f.name AS fn, 'len:' || n AS label, 'hole' AS kind, count(*) AS n
    FROM words w JOIN funcs f USING (doc_id) WHERE {_HOLE} GROUP BY ALL""",
)
def holes(spark, sf):
    found = ast_tables.holes_of(corpus.functions(spark, sf))
    return found.groupBy("module", "fn", "label", "kind").agg(F.count("*").alias("n"))


@query(
    "b_hole_free",
    f"""WITH {WITH_FUNCS}
    SELECT module, name FROM funcs f
    WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = f.doc_id AND {_HOLE})""",
)
def hole_free(spark, sf):
    found = ast_tables.holes_of(corpus.functions(spark, sf))
    return ast_tables.hole_free(corpus.functions(spark, sf), found).select("module", "name")


@query(
    "b_calls",
    f"WITH {_WITH_CALLS} SELECT module, fn, is_method, callee, count(*) AS n FROM calls GROUP BY ALL",
)
def calls(spark, sf):
    found = ast_tables.extract_calls(corpus.nodes(spark, sf, ["k", "name", "under_pruned"], ["call", "mcall"]))
    return found.groupBy("module", "fn", "is_method", "callee").agg(F.count("*").alias("n"))


@query(
    "b_calls_complete",
    f"""WITH {WITH_FUNCS}
    SELECT f.module, n % 7 = 4 AS is_method, count(*) AS n FROM words w JOIN funcs f USING (doc_id)
    WHERE NOT ({_HOLE}) AND n % 7 IN (0, 4) GROUP BY ALL""",
)
def calls_complete(spark, sf):
    found = ast_tables.extract_calls(corpus.nodes(spark, sf, ["k", "name", "under_pruned"], ["call", "mcall"]), strict_compat=False)
    return found.groupBy("module", "is_method").agg(F.count("*").alias("n"))


@query(
    "b_fn_stats",
    f"""WITH {WITH_STATS}
    SELECT module, name AS fn, ledger_nodes, matrix_nodes, holes, risk, max_depth FROM stats JOIN funcs USING (doc_id)""",
)
def fn_stats(spark, sf):
    stats = ast_tables.function_facts(corpus.functions(spark, sf))
    return stats.select("module", "fn", "ledger_nodes", "matrix_nodes", "holes", "risk", F.col("max_depth").cast("bigint").alias("max_depth"))


@query(
    "b_class_fields",
    f"""WITH {WITH_FUNCS}, touched AS (
      SELECT f.module, 'C' || (f.doc_id % 97) AS cls, w.id AS field FROM funcs f
      LEFT JOIN words w ON w.doc_id = f.doc_id AND NOT (w.n >= {HOLE_LENGTH}) AND w.n % 7 = 5)
    SELECT module, cls, coalesce(string_agg(DISTINCT field, ',' ORDER BY field), '') AS fields FROM touched GROUP BY ALL""",
)
def class_fields(spark, sf):
    nodes = corpus.nodes(spark, sf, ["k", "name", "recv"])
    fields = ast_tables.class_fields(corpus.functions(spark, sf), nodes)
    return fields.select("module", "cls", F.array_join("fields", ",").alias("fields"))


@query(
    "b_body_flags",
    f"""WITH {WITH_FUNCS}, f AS (
      SELECT doc_id, bool_or(m % 5 = 3) AS t, bool_or(m % 5 = 4) AS h, bool_or(NOT ({_HOLE}) AND n % 7 IN (0, 4, 5, 6)) AS r,
             bool_or(NOT ({_HOLE}) AND n % 7 IN (0, 1, 2, 4, 5, 6) AND id = 'tryFinally') AS t2,
             bool_or(NOT ({_HOLE}) AND n % 7 <> 3 AND id IN ('setField', 'setIndex', 'alloc')) AS h2,
             bool_or(NOT ({_HOLE}) AND n % 7 <> 3 AND id IN ('field', 'index', 'mcall', 'call', 'alloc', 'inOp', 'binop', 'loop', 'forIn', 'setIndex')) AS r2
      FROM words GROUP BY doc_id)
    SELECT module, name AS fn, coalesce(t OR t2, false) AS has_try_finally, coalesce(h OR h2, false) AS writes_heap,
           coalesce(r OR h OR r2, false) AS can_hole_or_loop
    FROM funcs LEFT JOIN f USING (doc_id)""",
)
def body_flags(spark, sf):
    return ast_tables.body_flags(corpus.functions(spark, sf))


@query(
    "b_census",
    f"""WITH {WITH_FUNCS}
    SELECT lang AS module, CAST(0 AS BIGINT) AS docstrings, CAST(0 AS BIGINT) AS doctests,
      CAST(sum(len(regexp_extract_all(text, '(?m)^\\s*assert\\b'))) FILTER (doc_id % 4 <> 3) AS BIGINT) AS asserts,
      CAST(0 AS BIGINT) AS raises,
      count(*) FILTER (doc_id % 4 <> 3 AND contains(text, 'hypothesis')) AS pbt_files,
      CAST(sum(len(regexp_extract_all(text, '(?m)^\\s*@given\\b'))) FILTER (doc_id % 4 <> 3 AND contains(text, 'hypothesis')) AS BIGINT) AS p0,
      CAST(0 AS BIGINT) AS test_files
    FROM documents GROUP BY ALL""".replace("AS p0", "AS pbt_raw").replace(
        "SELECT lang AS module", "SELECT * EXCLUDE (pbt_raw), coalesce(pbt_raw, 0) AS pbt_properties FROM (SELECT lang AS module"
    )
    + ")",
)
def census(spark, sf):
    docs = table(spark, sf, "documents")
    ext = F.expr("CASE doc_id % 4 WHEN 2 THEN '.c' WHEN 3 THEN '.txt' ELSE '.py' END")
    sources = docs.select(
        F.col("lang").alias("module"), F.concat(F.col("source"), F.lit("/d"), F.col("doc_id"), ext).alias("path"), "text"
    )
    return ast_tables.artifact_census(ast_tables.census_facts(corpus.functions(spark, sf)), sources)


@query(
    "b_dialects",
    """SELECT lang AS module, CASE WHEN py >= c THEN 'python' ELSE 'cLike' END AS matrix,
         CASE WHEN py >= c THEN 'python' ELSE 'cLike' END AS renderer,
         CASE WHEN txt > py + c THEN NULL WHEN py >= c THEN 'python' ELSE 'c' END AS language,
         CASE WHEN txt > py + c THEN 'refused' ELSE 'voted' END AS status
       FROM (SELECT lang, count(*) FILTER (doc_id % 4 IN (0, 1)) AS py, count(*) FILTER (doc_id % 4 = 2) AS c,
                    count(*) FILTER (doc_id % 4 = 3) AS txt FROM documents GROUP BY lang)""",
)
def dialects(spark, sf):
    functions = corpus.functions(spark, sf)
    matrix = ast_tables.dialect_vote(functions).select("module", F.col("dialect").alias("matrix"))
    renderer = ast_tables.dialect_vote(functions, on_unknown="refuse").select("module", F.col("dialect").alias("renderer"))
    compared = ast_tables.dialect_vote(functions, on_unknown="refuse_if_more").select("module", "language", "status")
    return matrix.join(renderer, "module").join(compared, "module")


@query(
    "b_name_kinds",
    f"""WITH {WITH_FUNCS}
    SELECT module, name, file, regexp_extract(name, ':<module>\\.(.+)$', 1) AS qualname, true AS is_method FROM funcs""",
)
def name_kinds(spark, sf):
    return ast_tables.name_kinds(corpus.functions(spark, sf))


@query(
    "c_fanout",
    f"WITH {_WITH_CALLS} SELECT f.module, f.name AS fn, count(DISTINCT callee) AS fanout, coalesce(string_agg(DISTINCT callee, ',' ORDER BY callee), '') AS callees FROM funcs f LEFT JOIN calls c ON c.module = f.module AND c.fn = f.name GROUP BY ALL",
)
def fanout(spark, sf):
    calls = ast_tables.extract_calls(corpus.nodes(spark, sf, ["k", "name", "under_pruned"], ["call", "mcall"]))
    found = graph.fanout(calls, ast_tables.KEY, functions=ast_tables.identified(corpus.functions(spark, sf)))
    return found.select("module", "fn", "fanout", F.array_join("callees", ",").alias("callees"))


@query(
    "c_dotted_tails",
    """WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^https?://([^/]+)', 1), '.') AS ps FROM pages)
    SELECT page_id, nth, array_to_string(list_slice(ps, nth + 2, len(ps)), '.') AS tail
    FROM (SELECT *, unnest(range(0, len(ps) - 1)) AS nth FROM p)""",
)
def dotted_tails(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    tails = table(spark, sf, "pages").select("page_id", F.posexplode(names.dotted_tails(host)).alias("nth", "tail"))
    return tails.select("page_id", F.col("nth").cast("bigint").alias("nth"), "tail")


@query("c_resolve_calls", f"WITH {_WITH_RESOLVED} SELECT * FROM resolved")
def resolve_calls(spark, sf):
    found = ast_tables.extract_calls(corpus.nodes(spark, sf, ["k", "name", "under_pruned"], ["call", "mcall"]))
    return graph.resolve_calls(found, corpus.functions(spark, sf).select("module", "name"))


_REQUESTS = "SELECT DISTINCT f.module, 'C' || (doc_id % 97) AS cls, w.id AS meth FROM funcs f JOIN words w USING (doc_id) WHERE w.n % 7 = 0 AND w.id <> ''"


def _requests(functions, nodes):
    """Each class asked for the names its own functions call freely."""
    free = nodes.where((F.col("k") == "call") & (F.col("name") != ""))
    return free.select("module", names.class_of(F.col("fn")).alias("cls"), F.col("name").alias("meth")).distinct()


_REQUESTED = _REQUESTS + f" AND NOT ({_HOLE})"


@query(
    "c_resolve_method",
    f"""WITH {_WITH_INDEX}, req AS ({_REQUESTED}),
    named AS (SELECT t.*, f.doc_id FROM tails t JOIN funcs f USING (module, name)),
    firsts2 AS (SELECT module, tail, arg_min(name, doc_id) AS name, count(*) AS c FROM named GROUP BY ALL)
    SELECT r.module, r.cls, r.meth, coalesce(q.name, f.name, s.name) AS target FROM req r
    LEFT JOIN firsts2 q ON q.module = r.module AND q.tail = r.cls || '.' || r.meth
    LEFT JOIN (SELECT DISTINCT module, name FROM funcs) f ON f.module = r.module AND f.name = r.meth
    LEFT JOIN firsts2 s ON s.module = r.module AND s.tail = r.meth AND s.c = 1""",
)
def resolve_method(spark, sf):
    functions = corpus.functions(spark, sf).select("module", "name", "pos")
    return graph.resolve_method(_requests(functions, corpus.nodes(spark, sf, ["k", "name"], ["call"])), functions)


@query(
    "c_class_defines",
    f"""WITH {_WITH_INDEX}, req AS ({_REQUESTED})
    SELECT r.* FROM req r WHERE EXISTS (SELECT 1 FROM tail_count t WHERE t.module = r.module AND t.tail = r.cls || '.' || r.meth)""",
)
def class_defines(spark, sf):
    functions = corpus.functions(spark, sf).select("module", "name", "pos")
    return graph.class_defines(_requests(functions, corpus.nodes(spark, sf, ["k", "name"], ["call"])), functions)


def _closing(spark, sf):
    """What closures need of each function, and all names: read several times by each, so bodies are opened and names made once."""
    functions = corpus.functions(spark, sf)
    return stored(ast_tables.function_facts(functions).select(*ast_tables.KEY, "holes", "calls")), stored(functions.select("module", "name"))


def _closure(facts, functions, resolver, only=None):
    calls = ast_tables.calls_of(facts)
    calls = calls if only is None else calls.where(only)
    free = facts.where("holes = 0").select("module", F.col("fn").alias("name"), F.col("fn_pos").alias("pos"))
    return graph.call_closed(free, calls, resolver(calls, functions)).select("module", "name")


@query(
    "c_call_closed",
    f"""WITH {_WITH_RESOLVED}
    SELECT module, name FROM funcs f
    WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = f.doc_id AND {_HOLE})
      AND NOT EXISTS (SELECT 1 FROM calls c JOIN resolved r USING (module, is_method, callee) WHERE c.module = f.module AND c.fn = f.name AND NOT r.resolved)""",
)
def call_closed(spark, sf):
    return _closure(*_closing(spark, sf), graph.resolve_calls)


@query("c_closure_agrees", "SELECT '' AS module, '' AS name, '' AS only_in WHERE false")
def closure_agrees(spark, sf):
    """Both derivations of the closure, compared by name: no row means they agree."""
    both = _closing(spark, sf)
    return graph.closure_agrees(_closure(*both, graph.resolve_calls), _closure(*both, graph.resolve_calls_by_scan))


@query(
    "c_closure_differs",
    f"""WITH {_WITH_RESOLVED}, leaks AS (SELECT c.module, c.fn, bool_or(is_method) AS by_method FROM calls c JOIN resolved r USING (module, is_method, callee) WHERE NOT r.resolved GROUP BY c.module, c.fn)
    SELECT f.module, f.name, 'second' AS only_in FROM funcs f JOIN leaks l ON l.module = f.module AND l.fn = f.name
    WHERE NOT by_method AND NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = f.doc_id AND {_HOLE})""",
)
def closure_differs(spark, sf):
    """The same comparison against a derivation that forgets free calls: functions whose only leaks these are must be told."""
    both = _closing(spark, sf)
    return graph.closure_agrees(_closure(*both, graph.resolve_calls), _closure(*both, graph.resolve_calls_by_scan, "is_method"))


_PCT = "CASE WHEN {b} = 0 THEN 'n/a' ELSE CAST(CAST(floor({a} * 100.0 / {b}) AS BIGINT) AS VARCHAR) || '%' END"
LEDGER_SQL = f"""WITH {_WITH_RESOLVED}, {WITH_STATS[len(WITH_FUNCS) + 1:]},
    leaks AS (SELECT DISTINCT c.module, c.fn FROM calls c JOIN resolved r USING (module, is_method, callee) WHERE NOT r.resolved),
    roll AS (
      SELECT f.module, count(*) AS functions, CAST(sum(ledger_nodes) AS BIGINT) AS nodes, CAST(sum(holes) AS BIGINT) AS holes,
        count(*) FILTER (holes = 0) AS hole_free, count(*) FILTER (holes = 0 AND l.fn IS NULL) AS verifiable_core,
        CAST(sum(risk) AS BIGINT) AS dynamic_risk
      FROM funcs f JOIN stats USING (doc_id) LEFT JOIN leaks l ON l.module = f.module AND l.fn = f.name GROUP BY ALL)
    SELECT module, 'python' AS dialect, functions, nodes, holes, hole_free, verifiable_core, dynamic_risk,
      {_PCT.format(a='holes', b='nodes')} AS holes_pct, {_PCT.format(a='hole_free', b='functions')} AS hole_free_pct,
      {_PCT.format(a='verifiable_core', b='functions')} AS core_pct
    FROM roll"""


@query("d_coverage_ledger", LEDGER_SQL)
def coverage_ledger(spark, sf):
    """The flagship: what share of each corpus is hole-free and call-closed, and what may still hole at run time."""
    return ledger.coverage_ledger(*_counted(spark, sf))


@query(
    "d_hole_tally",
    f"""WITH {WITH_WORDS}, c AS (SELECT module, 'len:' || n AS label, count(*) AS n FROM words WHERE {_HOLE} GROUP BY module, words.n),
    r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, label) AS rank FROM c)
    SELECT module, label, n, rank FROM r WHERE rank <= 3
    UNION ALL SELECT module, NULL, count(*) - 3, 4 FROM r GROUP BY module HAVING count(*) > 3""",
)
def hole_tally(spark, sf):
    found = ast_tables.holes_of(corpus.functions(spark, sf))
    return ledger.tally(found, "label", by=["module"], top=3).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "d_language_matrix",
    f"""WITH {WITH_STATS}
    SELECT module, '.py' AS ext, 'python' AS dialect, count(*) AS functions, CAST(sum(matrix_nodes) AS BIGINT) AS nodes,
      CAST(sum(holes) AS BIGINT) AS holes, count(*) FILTER (holes = 0) AS hole_free,
      round(100.0 * sum(holes) / sum(matrix_nodes), 6) AS hole_pct,
      round(100.0 * count(*) FILTER (holes = 0) / count(*), 6) AS hole_free_pct
    FROM funcs JOIN stats USING (doc_id) GROUP BY ALL""",
)
def language_matrix(spark, sf):
    matrix = ledger.language_matrix(*_counted(spark, sf))
    return matrix.withColumn("hole_pct", F.round("hole_pct", 6)).withColumn("hole_free_pct", F.round("hole_free_pct", 6))


@query(
    "d_hole_causes",
    f"""WITH {WITH_WORDS}, c AS (SELECT module, 'len:' || n AS label, count(*) AS n FROM words WHERE {_HOLE} GROUP BY module, words.n),
    r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, label) AS rank FROM c)
    SELECT module, label, n, rank FROM r WHERE rank <= 15
    UNION ALL SELECT module, NULL, count(*) - 15, 16 FROM r GROUP BY module HAVING count(*) > 15""",
)
def hole_causes(spark, sf):
    """The part of the language matrix that says why: fifteen causes of each corpus."""
    found = ast_tables.holes_of(corpus.functions(spark, sf))
    return ledger.hole_causes(found).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "d_corpus_shape",
    f"""WITH {WITH_STATS}
    SELECT module, count(*) AS functions, CAST(sum(matrix_nodes) AS BIGINT) AS nodes, max(max_depth) AS max_depth,
      CAST(sum(holes) AS BIGINT) AS holes FROM funcs JOIN stats USING (doc_id) GROUP BY ALL""",
)
def corpus_shape(spark, sf):
    shape = ledger.corpus_shape(*_counted(spark, sf))
    return shape.drop("bytes").withColumn("max_depth", F.col("max_depth").cast("bigint"))


@query(
    "d_hole_sites",
    f"""WITH {WITH_FUNCS}, h AS (SELECT f.module, f.name, doc_id, 'len:' || n AS label, count(*) AS c
      FROM words w JOIN funcs f USING (doc_id) WHERE {_HOLE} GROUP BY f.module, f.name, doc_id, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY module, label ORDER BY doc_id) AS r FROM h)
    SELECT module, label, CAST(sum(c) AS BIGINT) AS occurrences, count(*) AS n_functions,
      string_agg(name, ' ' ORDER BY r) FILTER (r <= 5) AS sites FROM r GROUP BY ALL""",
)
def hole_sites(spark, sf):
    found = ast_tables.holes_of(corpus.functions(spark, sf))
    sites = ledger.hole_sites(found)
    return sites.withColumn("sites", F.array_join("sites", " "))


@query(
    "d_empty_bodies",
    f"""WITH {WITH_LINES} , b AS (SELECT doc_id, module, sum(len(ws)) = 0 AS empty FROM lines GROUP BY ALL)
    SELECT module, CASE WHEN empty THEN 'empty' ELSE 'substantive' END AS body, count(*) AS n FROM b GROUP BY ALL""",
)
def empty_bodies(spark, sf):
    survivors = corpus.functions(spark, sf).select("module", F.col("name").alias("fn"))
    return ledger.empty_body_split(survivors, corpus.nodes(spark, sf, ["k"]))


@query(
    "c_unique_ident",
    f"""WITH {WITH_FUNCS}, b AS (
      SELECT *, substring('f_' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g'), 1, 12) AS base FROM funcs)
    SELECT module, name, base || repeat('''', CAST(row_number() OVER (PARTITION BY module, base ORDER BY doc_id) - 1 AS INTEGER)) AS ident FROM b""",
)
def unique_ident(spark, sf):
    """Cut at 12 characters here, so that many names collide."""
    return graph.unique_ident(corpus.functions(spark, sf), limit=12).select("module", "name", "ident")
