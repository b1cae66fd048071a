"""Program-graph operators bound to pages, documents, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import graph, ledger, reachability
from attestry.plans.registry import query, table

# Effect classes with patterns that occur in the texts at hand, one of them upper-case and so unmatchable.
_EFFECTS = {"io": ["open", "ing", "elle"], "ffi": ["jni", "sch"], "reflection": ["Class.forName"], "nondeterm": ["time", "ndre"]}
_HAS = {c: " OR ".join(f"contains(lower(text), '{p}')" for p in ps) for c, ps in _EFFECTS.items()}
_EFFECT_LIST = "[x FOR x IN [" + ", ".join(f"CASE WHEN {h} THEN '{c}' END" for c, h in _HAS.items()) + "] IF x IS NOT NULL]"


def _effects(spark, sf):
    return graph.classify_effects(table(spark, sf, "documents"), _EFFECTS, key=["doc_id"], code="text")


@query("c_effects", f"SELECT doc_id, array_to_string({_EFFECT_LIST}, ',') AS effects FROM documents")
def effects(spark, sf):
    return _effects(spark, sf).select("doc_id", F.array_join("effects", ",").alias("effects"))


_SCORED = f"""SELECT doc_id, len({_EFFECT_LIST}) AS n_effects, n_chars % 7 AS fanout,
  length(text) - length(replace(text, chr(10), '')) + 1 AS loc, n_chars % 5 AS branches FROM documents"""


def _scored(spark, sf):
    shape = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 7).alias("fanout"), (F.regexp_count("text", F.lit("\n")) + 1).alias("loc"),
        (F.col("n_chars") % 5).alias("branches"),
    )
    counted = _effects(spark, sf).select("doc_id", F.size("effects").alias("n_effects"))
    return graph.priority_score(shape.join(counted, "doc_id"))


@query(
    "c_priority",
    f"""SELECT doc_id, round(100.0::DOUBLE - n_effects * 25.0::DOUBLE - fanout * 2.0::DOUBLE - loc * 0.1::DOUBLE - branches * 1.5::DOUBLE, 6)
      AS formalizability, n_effects = 0 AS pure FROM ({_SCORED})""",
)
def priority(spark, sf):
    return _scored(spark, sf).select("doc_id", F.round("formalizability", 6).alias("formalizability"), "pure")


@query(
    "c_pure_leaves",
    f"SELECT count(*) AS functions, count(*) FILTER (n_effects = 0 AND fanout = 0) AS pure_leaves FROM ({_SCORED})",
)
def pure_leaves(spark, sf):
    return graph.pure_leaves(_scored(spark, sf))


@query(
    "d_effect_histogram",
    f"""WITH e AS (SELECT lang AS module, {_EFFECT_LIST} AS es FROM documents)
    SELECT module, effect, count(*) AS n FROM (SELECT module, unnest(CASE WHEN len(es) = 0 THEN ['pure'] ELSE es END) AS effect FROM e) GROUP BY ALL""",
)
def effect_histogram(spark, sf):
    found = graph.classify_effects(table(spark, sf, "documents"), _EFFECTS, key=["doc_id", "lang"], code="text")
    return ledger.effect_histogram(found.withColumnRenamed("lang", "module"))


# ---- modules out of page paths: half of the paths exist, some as packages, some only under their last segment

_PATHS = """paths AS (SELECT page_id, rtrim(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/') AS p FROM pages),
  mods AS (
    SELECT p || CASE WHEN page_id % 4 = 0 THEN '.py:<module>' ELSE '/__init__.py:<module>' END AS full_name FROM paths WHERE page_id % 2 = 0
    UNION SELECT string_split(p, '/')[-1] || '.py:<module>' FROM paths WHERE page_id % 10 = 1)"""
_SPELLED = """spelled AS (
    SELECT path, arg_min(full_name, package) AS module_name FROM (
      SELECT full_name, CASE WHEN full_name LIKE '%/__init__.py:<module>' THEN 1 ELSE 0 END AS package,
             regexp_replace(regexp_replace(full_name, '\\.py:<module>$', ''), '/__init__$', '') AS path FROM mods) GROUP BY path)"""


def _paths(spark, sf):
    p = F.rtrim(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), F.lit("/"))
    return table(spark, sf, "pages").select("page_id", p.alias("p"))


def _modules(spark, sf):
    paths = _paths(spark, sf)
    suffix = F.when(F.col("page_id") % 4 == 0, ".py:<module>").otherwise("/__init__.py:<module>")
    whole = paths.where("page_id % 2 = 0").select(F.concat("p", suffix).alias("full_name"))
    short = paths.where("page_id % 10 = 1").select(
        F.concat(F.element_at(F.split("p", "/", -1), -1), F.lit(".py:<module>")).alias("full_name")
    )
    return whole.unionByName(short).distinct()


@query(
    "c_resolve_module",
    f"""WITH {_PATHS}, {_SPELLED}, want AS (SELECT DISTINCT 'pkg/lib/' || p AS path FROM paths UNION SELECT p FROM paths),
    segs AS (SELECT path, string_split(path, '/') AS ss FROM want),
    suf AS (SELECT path, d, array_to_string(list_slice(ss, d + 1, len(ss)), '/') AS s FROM (SELECT *, unnest(range(0, len(ss))) AS d FROM segs)),
    hit AS (SELECT suf.path, arg_min(module_name, d) AS module_name, CAST(min(d) AS BIGINT) AS dropped FROM suf JOIN spelled ON spelled.path = suf.s GROUP BY suf.path)
    SELECT want.path, module_name, dropped FROM want LEFT JOIN hit USING (path)""",
)
def resolve_module(spark, sf):
    paths = _paths(spark, sf)
    wanted = paths.select(F.concat(F.lit("pkg/lib/"), "p").alias("path")).unionByName(paths.select(F.col("p").alias("path")))
    found = graph.resolve_module(wanted, _modules(spark, sf))
    return found.withColumn("dropped", F.col("dropped").cast("bigint"))


def _definitions(modules, every: int, names: list[str]):
    """Top-level definitions of the modules whose name's length is a multiple of `every`."""
    listed = F.explode(F.array(*[F.lit(n) for n in names]))
    return modules.where(F.length("full_name") % every == 0).select(
        F.col("full_name").alias("module_name"), listed.alias("name")
    ).withColumn("full_name", F.concat_ws(".", "module_name", "name"))


@query("c_classify_import")
def classify_import(spark, sf):
    """Imports of every page path in six spellings; no SQL, the rule is checked on a fixture."""
    paths, modules = _paths(spark, sf), _modules(spark, sf)
    dotted = F.replace("p", F.lit("/"), F.lit("."))
    kinds = [
        (F.lit(""), dotted, False), (F.lit(""), dotted, True), (F.concat(F.lit("pkg."), dotted), F.lit("fn"), False),
        (dotted, F.lit("Cls"), False), (F.lit("."), F.element_at(F.split("p", "/", -1), -1), False),
        (F.lit("__future__"), F.lit("annotations"), False),
    ]
    imports = paths.select(
        F.concat("p", F.lit(".py")).alias("file"),
        F.explode(F.array(*[F.struct(p.alias("prefix"), n.alias("name"), F.lit(a).alias("aliased")) for p, n, a in kinds])).alias("i"),
    ).select("file", "i.*")
    functions, classes = _definitions(modules, 2, ["fn"]), _definitions(modules, 3, ["Cls"])
    aliases = _definitions(modules, 5, ["alias"])
    found = graph.classify_import(imports, modules, functions, classes, aliases)
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


# ---- scopes out of documents: module, function and inner function, each using and binding words

_SCOPES = """scopes AS (
    SELECT DISTINCT 'm' || (doc_id % 50) || '.py:<module>' AS full_name, '<module>' AS name FROM documents
    UNION SELECT 'm' || (doc_id % 50) || '.py:<module>.f' || (doc_id % 7), 'f' || (doc_id % 7) FROM documents
    UNION SELECT 'm' || (doc_id % 50) || '.py:<module>.f' || (doc_id % 7) || '.g' || (doc_id % 3), 'g' || (doc_id % 3) FROM documents WHERE doc_id % 11 <> 0),
  ws AS (
    SELECT doc_id, w, j FROM (SELECT doc_id, string_split(text, ' ') AS ws, unnest(range(0, len(string_split(text, ' ')))) AS j, ws[j + 1] AS w FROM documents)),
  uses AS (SELECT DISTINCT 'm' || (doc_id % 50) || '.py:<module>.f' || (doc_id % 7) || '.g' || (doc_id % 3) AS full_name, w AS ident FROM ws WHERE doc_id % 11 <> 0 AND length(w) % 3 = 0),
  binds AS (
    SELECT DISTINCT 'm' || (doc_id % 50) || '.py:<module>.f' || (doc_id % 7) AS full_name, w AS ident FROM ws WHERE length(w) % 2 = 0
    UNION SELECT 'm' || (doc_id % 50) || '.py:<module>.f' || (doc_id % 7) || '.g' || (doc_id % 3), w FROM ws WHERE length(w) % 4 = 1 AND doc_id % 11 <> 0),
  chain AS (
    SELECT full_name, 0 AS level, full_name AS anc FROM scopes
    UNION ALL SELECT full_name, 1, regexp_replace(full_name, '\\.[^.]*$', '') FROM scopes WHERE name <> '<module>'
    UNION ALL SELECT full_name, 2, regexp_replace(full_name, '\\.[^.]*\\.[^.]*$', '') FROM scopes WHERE name LIKE 'g%'),
  bound AS (
    SELECT u.full_name, u.ident, min(level) AS at_level FROM uses u JOIN chain c USING (full_name) JOIN binds b ON b.full_name = c.anc AND b.ident = u.ident GROUP BY ALL),
  free AS (
    SELECT DISTINCT c.anc AS full_name, u.ident FROM uses u JOIN chain c USING (full_name) LEFT JOIN bound b ON b.full_name = u.full_name AND b.ident = u.ident
    WHERE b.at_level IS NULL OR c.level < b.at_level)"""


def _scopes(spark, sf):
    docs = table(spark, sf, "documents")
    module = F.concat(F.lit("m"), F.col("doc_id") % 50, F.lit(".py:<module>"))
    fn = F.concat(module, F.lit(".f"), F.col("doc_id") % 7)
    inner = F.concat(fn, F.lit(".g"), F.col("doc_id") % 3)
    has_inner = docs.where("doc_id % 11 <> 0")
    methods = (
        docs.select(module.alias("full_name"), F.lit("<module>").alias("name"))
        .unionByName(docs.select(fn.alias("full_name"), F.concat(F.lit("f"), F.col("doc_id") % 7).alias("name")))
        .unionByName(has_inner.select(inner.alias("full_name"), F.concat(F.lit("g"), F.col("doc_id") % 3).alias("name")))
        .distinct()
    )
    words = lambda df, owner: df.select(owner.alias("full_name"), F.explode(F.split("text", " ", -1)).alias("ident"))
    size = F.length("ident")
    uses = words(has_inner, inner).where(size % 3 == 0)
    binds = words(docs, fn).where(size % 2 == 0).unionByName(words(has_inner, inner).where(size % 4 == 1))
    return methods, uses, binds


@query("c_free_names", f"WITH {_SCOPES} SELECT full_name, ident FROM free")
def free_names(spark, sf):
    return graph.free_names(*_scopes(spark, sf))


@query(
    "c_captures",
    f"""WITH {_SCOPES} SELECT s.full_name, EXISTS (
      SELECT 1 FROM free f JOIN chain c ON c.full_name = f.full_name AND c.level > 0 AND c.anc NOT LIKE '%<module>'
      JOIN binds b ON b.full_name = c.anc AND b.ident = f.ident WHERE f.full_name = s.full_name) AS is_closure
    FROM (SELECT DISTINCT full_name FROM scopes) s""",
)
def captures(spark, sf):
    methods, uses, binds = _scopes(spark, sf)
    return graph.closures(methods, uses, binds)


@query(
    "c_class_captures",
    f"""WITH {_SCOPES}, closures AS (
      SELECT DISTINCT f.full_name FROM free f JOIN chain c ON c.full_name = f.full_name AND c.level > 0 AND c.anc NOT LIKE '%<module>'
      JOIN binds b ON b.full_name = c.anc AND b.ident = f.ident)
    SELECT s.full_name, EXISTS (SELECT 1 FROM closures c WHERE starts_with(c.full_name, s.full_name || '.')) AS captures
    FROM (SELECT DISTINCT full_name FROM scopes WHERE name LIKE 'f%') s""",
)
def class_captures(spark, sf):
    """The middle scopes stand for classes."""
    methods, uses, binds = _scopes(spark, sf)
    found = graph.closures(methods, uses, binds)
    return graph.class_captures(methods.where("name LIKE 'f%'"), found)


@query(
    "c_enclosing_class",
    """WITH c AS (SELECT DISTINCT 'm' || doc_id % 20 || '.' || CASE doc_id % 7 WHEN 0 THEN '__' ELSE '_C' || doc_id % 7 END AS full_name, CASE doc_id % 7 WHEN 0 THEN '__' ELSE '_C' || doc_id % 7 END AS name FROM documents WHERE doc_id % 5 <> 0),
    f AS (SELECT DISTINCT 'm' || doc_id % 20 || '.' || CASE doc_id % 7 WHEN 0 THEN '__' ELSE '_C' || doc_id % 7 END || CASE WHEN doc_id % 3 = 0 THEN '.outer.' ELSE '.' END || n AS full_name, 'm' || doc_id % 20 || '.' || CASE doc_id % 7 WHEN 0 THEN '__' ELSE '_C' || doc_id % 7 END AS above, n AS name
      FROM (SELECT doc_id, ['__x', '__init__', '_y', 'z', '__'][doc_id % 4 + 1] AS n FROM documents)),
    g AS (SELECT f.full_name, f.name, c.name AS cls FROM f LEFT JOIN c ON c.full_name = f.above)
    SELECT full_name, name, cls, CASE WHEN name = '__x' AND cls <> '__' THEN '_C' || substring(cls, 3) || name ELSE name END AS mangled FROM g""",
)
def enclosing_class(spark, sf):
    """Private, special and plain names, in classes, below a function of a class, in a class of underscores only, and where the class is missing."""
    number = F.col("doc_id") % 7
    cls = F.when(number == 0, "__").otherwise(F.concat(F.lit("_C"), number))
    above = F.concat(F.lit("m"), F.col("doc_id") % 20, F.lit("."), cls)
    docs = table(spark, sf, "documents")
    name = F.element_at(F.array(*map(F.lit, ["__x", "__init__", "_y", "z"])), (F.col("doc_id") % 4 + 1).cast("int"))
    functions = docs.select(F.concat(above, F.when(F.col("doc_id") % 3 == 0, ".outer.").otherwise("."), name).alias("full_name"), name.alias("name"))
    return graph.enclosing_class(functions, docs.where("doc_id % 5 <> 0").select(above.alias("full_name"), cls.alias("name")))


@query(
    "c_builtin_bases",
    """WITH r AS (SELECT 'c' || p_partkey // 3 AS name, CASE p_size % 7 WHEN 0 THEN 'tuple' WHEN 1 THEN 'list' WHEN 2 THEN 'tuple' ELSE NULL END AS base FROM part)
    SELECT name, min(base) AS base FROM r WHERE base IS NOT NULL GROUP BY name HAVING count(DISTINCT base) = 1""",
)
def builtin_bases(spark, sf):
    """Three parts are one class name: the size picks the bases, and a name seen with two modelled bases is dropped."""
    bases = F.expr(
        """CASE p_size % 7 WHEN 0 THEN array('builtins.tuple', 'object') WHEN 1 THEN array('list') WHEN 2 THEN array('ANY', '__builtin.tuple')
           WHEN 3 THEN array('tuple', 'list') WHEN 4 THEN array('Other') ELSE array('x.object') END"""
    )
    return graph.builtin_bases(table(spark, sf, "part").select(F.concat(F.lit("c"), F.expr("p_partkey div 3")).alias("name"), bases.alias("bases")))


@query(
    "c_module_aliases",
    """WITH a AS (SELECT p_brand AS scope, p_name AS target, p_type AS value_ident FROM part), d AS (SELECT DISTINCT p_brand || '.' || p_type AS full_name FROM part WHERE p_size % 3 = 0
      UNION SELECT p_brand || '.' || p_name FROM part WHERE p_size % 5 = 0),
    once AS (SELECT scope, target, min(value_ident) AS value_ident FROM a GROUP BY ALL HAVING count(*) = 1)
    SELECT scope AS module_name, target AS name, value_ident FROM once WHERE scope || '.' || value_ident IN (SELECT full_name FROM d)
      AND scope || '.' || target NOT IN (SELECT full_name FROM d) AND target <> value_ident""",
)
def module_aliases(spark, sf):
    part = table(spark, sf, "part")
    assignments = part.select(F.col("p_brand").alias("scope"), F.col("p_name").alias("target"), F.col("p_type").alias("value_ident"))
    defined = part.where("p_size % 3 = 0").select(F.concat_ws(".", "p_brand", "p_type").alias("full_name")).unionByName(
        part.where("p_size % 5 = 0").select(F.concat_ws(".", "p_brand", "p_name").alias("full_name"))
    )
    return graph.module_aliases(assignments, defined)


@query(
    "c_bound_methods",
    """SELECT p_brand AS scope, p_name AS target, min(p_type) AS receiver, min('a' || p_size) AS attr FROM part GROUP BY ALL HAVING count(*) = 1""",
)
def bound_methods(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("scope"), F.col("p_name").alias("target"), F.col("p_type").alias("receiver"),
        F.concat(F.lit("a"), "p_size").alias("attr"),
    )
    return graph.bound_methods(rows)


@query(
    "c_module_members",
    f"""WITH {_PATHS}, {_SPELLED}, m AS (SELECT DISTINCT full_name FROM mods),
    mp AS (SELECT full_name, regexp_replace(regexp_replace(full_name, '\\.py:<module>$', ''), '/__init__$', '') AS path FROM m),
    c AS (
      SELECT full_name AS module_name, 'fn' AS name, 'function' AS source, 0 AS r FROM m WHERE length(full_name) % 2 = 0
      UNION ALL SELECT full_name, 'fn', 'class', 1 FROM m WHERE length(full_name) % 3 = 0
      UNION ALL SELECT full_name, 'alias', 'alias', 2 FROM m WHERE length(full_name) % 5 = 0
      UNION ALL SELECT p.full_name, regexp_extract(k.path, '([^/]*)$', 1), 'submodule', 3 FROM mp k JOIN mp p
        ON p.path = CASE WHEN contains(k.path, '/') THEN regexp_extract(k.path, '^(.*)/[^/]*$', 1) ELSE '' END WHERE k.path <> '')
    SELECT module_name, name, arg_min(source, r) AS source FROM c GROUP BY ALL""",
)
def module_members(spark, sf):
    modules = _modules(spark, sf)
    functions, classes = _definitions(modules, 2, ["fn"]), _definitions(modules, 3, ["fn"])
    return graph.module_members(modules, functions, classes, _definitions(modules, 5, ["alias"]))


@query(
    "c_drop_synthetic",
    """WITH m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<module>' WHEN 1 THEN '<global>' WHEN 2 THEN '<metaClassAdapter>' ELSE 'f' END AS name, doc_id % 10 = 9 AS ext, source FROM documents)
    SELECT doc_id, name IN ('<module>', '<global>') AS is_initializer FROM m
    WHERE NOT ext AND name <> '<metaClassAdapter>'""",
)
def drop_synthetic(spark, sf):
    name = F.expr("CASE doc_id % 6 WHEN 0 THEN '<module>' WHEN 1 THEN '<global>' WHEN 2 THEN '<metaClassAdapter>' ELSE 'f' END")
    methods = table(spark, sf, "documents").select(
        "doc_id", name.alias("name"), F.concat("source", F.lit(".py:"), name).alias("full_name"), (F.col("doc_id") % 10 == 9).alias("is_external")
    )
    return graph.drop_synthetic(methods).select("doc_id", "is_initializer")


@query(
    "c_elided_calls",
    """SELECT l_returnflag AS module, count(*) FILTER (l_linenumber IN (1, 3)) AS elided, count(*) FILTER (l_linenumber NOT IN (1, 3)) AS kept FROM lineitem GROUP BY ALL""",
)
def elided_calls(spark, sf):
    callee = F.expr("CASE l_linenumber WHEN 1 THEN 'spin_lock' WHEN 3 THEN 'mutex_unlock' ELSE 'kfree' END")
    return graph.elided_calls(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("module"), callee.alias("callee")))


@query(
    "c_operator_coverage",
    """WITH o AS (SELECT l_returnflag AS module, l_linenumber AS n, l_quantity > 25 AS c_family, CAST(l_quantity AS INTEGER) % 4 AS t FROM lineitem)
    SELECT module, core_op, hole_label, count(*) AS n FROM (
      SELECT module, CASE WHEN n = 1 AND c_family AND t = 0 THEN NULL WHEN n = 1 THEN '+' WHEN n = 2 AND (NOT c_family OR t = 1) THEN '>>'
               WHEN n = 2 AND t = 2 THEN '>>>' WHEN n = 2 THEN NULL WHEN n = 3 THEN '~' WHEN n = 4 THEN '&' ELSE NULL END AS core_op,
             CASE WHEN n = 1 AND c_family AND t = 0 THEN 'cstr:pointer-arith' WHEN n = 2 AND c_family AND t NOT IN (1, 2) THEN 'shift:unknown-signedness'
               WHEN n > 4 THEN 'op:power' END AS hole_label FROM o) GROUP BY ALL""",
)
def operator_coverage(spark, sf):
    op = F.expr(
        """CASE l_linenumber WHEN 1 THEN '<operator>.addition' WHEN 2 THEN '<operator>.arithmeticShiftRight' WHEN 3 THEN '<operator>.not'
           WHEN 4 THEN '<operator>.and' ELSE '<operator>.power' END"""
    )
    kind = F.expr("CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'const char *' WHEN 1 THEN 'int' WHEN 2 THEN 'size_t' ELSE 'Foo' END")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("module"), op.alias("operator"), kind.alias("operand_type"), (F.col("l_quantity") > 25).alias("c_family")
    )
    return graph.operator_coverage(rows)


# ---- reachability over orders: each order refers to the one with half its key, roots are the customers' smallest

_REACH = """RECURSIVE edges AS (SELECT o_orderkey AS src, o_orderkey // 2 AS dst FROM orders WHERE o_orderkey > 0),
  roots AS (SELECT o_orderkey AS root FROM orders WHERE o_orderkey % 10 = 0),
  reached(root, decl) AS (SELECT root, root FROM roots UNION SELECT r.root, e.dst FROM reached r JOIN edges e ON e.src = r.decl)"""


def _reached(spark, sf, kind: str = "bigint"):
    orders = table(spark, sf, "orders")
    key, half = F.col("o_orderkey"), F.expr("o_orderkey div 2")
    edges = orders.where("o_orderkey > 0").select(key.cast(kind).alias("src"), half.cast(kind).alias("dst"))
    roots = orders.where("o_orderkey % 10 = 0").select(key.cast(kind).alias("root"))
    return reachability.Reach(edges, roots), roots


@query("c_reach", f"WITH {_REACH} SELECT root, count(*) AS dep_count, CAST(sum(decl) AS BIGINT) AS total FROM reached GROUP BY root")
def reach(spark, sf):
    return _reached(spark, sf)[0].summed(dep_count=lambda node: F.lit(1), total=lambda node: node)


@query(
    "c_depends_on",
    f"""WITH {_REACH} SELECT root, root % 7 AS impl, CASE WHEN EXISTS (SELECT 1 FROM reached x WHERE x.root = roots.root AND x.decl = roots.root % 7)
      THEN 'DEPENDS' ELSE 'VACUOUS' END AS status FROM roots""",
)
def depends_on(spark, sf):
    reached, roots = _reached(spark, sf)
    return reachability.depends_on(reached, roots.select("root", (F.col("root") % 7).alias("impl")))


@query(
    "c_declaration_evidence",
    f"""WITH {_REACH} SELECT root, count(*) AS dep_count, coalesce(string_agg(CAST(decl AS VARCHAR), ',' ORDER BY CAST(decl AS VARCHAR)) FILTER (decl IN (1, 2, 5)), '') AS axioms,
      NOT coalesce(bool_or(decl = 5), false) AS clean FROM reached GROUP BY root""",
)
def declaration_evidence(spark, sf):
    reached, _ = _reached(spark, sf, "string")
    axioms = table(spark, sf, "orders").where("o_orderkey IN (1, 2, 5)").select(F.col("o_orderkey").cast("string").alias("axiom"))
    found = reachability.declaration_evidence(reached, axioms, ["5"])
    return found.withColumn("root", F.col("root").cast("bigint")).withColumn("axioms", F.array_join("axioms", ","))


_AXIOMS = "CASE doc_id % 4 WHEN 0 THEN ['propext'] WHEN 1 THEN ['propext', 'sorryAx'] WHEN 2 THEN ['my.ax', 'Classical.choice'] ELSE [] END"


def _decls(spark, sf):
    axioms = F.expr(_AXIOMS.replace("[", "array(").replace("]", ")").replace("ELSE array()", "ELSE CAST(array() AS ARRAY<STRING>)"))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("name"), F.col("source").alias("module"),
        F.when(F.col("doc_id") % 9 == 0, "axiom").otherwise("theorem").alias("kind"), axioms.alias("axioms"),
    )


@query(
    "c_axiom_basis",
    """SELECT 'd' || doc_id AS name, source AS module, CASE WHEN doc_id % 9 = 0 THEN 'axiom' ELSE 'theorem' END AS kind,
      CASE WHEN doc_id % 4 = 1 THEN 'sorryAx' ELSE '' END AS leaked, CASE WHEN doc_id % 4 = 2 THEN 'my.ax' ELSE '' END AS nonstandard,
      doc_id % 9 = 0 AS declared_axiom, CASE WHEN doc_id % 4 = 1 THEN 'LEAK' ELSE 'CLEAN' END AS status FROM documents""",
)
def axiom_basis(spark, sf):
    found = graph.axiom_basis(_decls(spark, sf))
    return found.withColumn("leaked", F.array_join("leaked", ",")).withColumn("nonstandard", F.array_join("nonstandard", ","))


@query("c_axiom_histogram", f"SELECT axiom, count(*) AS n FROM (SELECT unnest({_AXIOMS}) AS axiom FROM documents) GROUP BY axiom")
def axiom_histogram(spark, sf):
    return graph.axiom_histogram(_decls(spark, sf))


@query(
    "c_resolve_root",
    """WITH f AS (SELECT DISTINCT 'repo/src/' || source || '/d' || doc_id AS path FROM documents WHERE doc_id % 3 <> 0
        UNION SELECT 'repo/' || source || '/d' || doc_id FROM documents WHERE doc_id % 3 = 0),
      h AS (SELECT r.root, r.rank, count(*) AS hits FROM (SELECT DISTINCT source || '/d' || doc_id AS rel FROM documents) d,
        (VALUES ('repo', 0), ('repo/src', 1), ('repo/lib', 2)) r(root, rank) WHERE r.root || '/' || rel IN (SELECT path FROM f) GROUP BY ALL)
    SELECT root, hits FROM h ORDER BY hits DESC, rank LIMIT 1""",
)
def resolve_root(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/d"), "doc_id").alias("rel"))
    root = F.when(F.col("doc_id") % 3 == 0, "repo/").otherwise("repo/src/")
    roots = spark.createDataFrame([("repo", 0), ("repo/src", 1), ("repo/lib", 2)], "root STRING, rank INT")
    return graph.resolve_root(docs, roots, docs.select(F.concat(root, "rel").alias("path")), "repo")


@query(
    "d_tally",
    """WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rank FROM c)
    SELECT label, n, rank FROM r WHERE rank <= 12 UNION ALL SELECT NULL, count(*) - 12, 13 FROM r HAVING count(*) > 12""",
)
def tally(spark, sf):
    return ledger.tally(table(spark, sf, "documents"), "source").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "d_stage_table",
    """WITH s AS (SELECT l_suppkey AS target, l_linenumber AS n, l_returnflag, l_quantity, l_orderkey FROM lineitem),
    o AS (SELECT target, n, arg_min(CASE WHEN l_returnflag = 'R' THEN 'TIMEOUT' WHEN l_returnflag = 'N' THEN 'FAIL' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END, l_orderkey * 100 + l_quantity) AS cell, max(l_quantity) AS rss FROM s GROUP BY ALL)
    SELECT CAST(target AS VARCHAR) AS target, coalesce(max(cell) FILTER (n = 1), '—') AS parse, coalesce(max(cell) FILTER (n = 2), '—') AS graph, coalesce(max(cell) FILTER (n = 3), '—') AS export,
      coalesce(max(cell) FILTER (n = 4), '—') AS render, coalesce(max(cell) FILTER (n = 5), '—') AS build, coalesce(max(cell) FILTER (n = 6), '—') AS ledger, coalesce(max(cell) FILTER (n = 7), '—') AS audit, max(rss) AS peak_rss_mb FROM o GROUP BY target""",
)
def stage_table(spark, sf):
    """Line items as stage runs; of several runs of one stage the first order's counts."""
    lines = table(spark, sf, "lineitem")
    names = ["parse", "graph", "export", "render", "build", "ledger", "audit"]
    first = lines.groupBy("l_suppkey", "l_linenumber").agg(
        F.min_by(F.struct("l_returnflag", "l_quantity"), F.col("l_orderkey") * 100 + F.col("l_quantity")).alias("r"), F.max("l_quantity").alias("peak")
    )
    stages = first.select(
        F.col("l_suppkey").cast("string").alias("target"), F.element_at(F.array(*map(F.lit, names)), F.col("l_linenumber")).alias("stage"),
        (F.col("r.l_returnflag") == "A").alias("ok"), F.col("r.l_quantity").alias("seconds"), (F.col("r.l_returnflag") == "R").alias("timed_out"),
        F.col("peak").alias("peak_rss_mb"),
    )
    return ledger.stage_table(stages, names)


@query(
    "d_proved_inventory",
    """WITH m AS (SELECT source, count(*) FILTER (doc_id % 5 = 0) AS bad, CAST(sum(len(regexp_extract_all(text, '(?m)^\\s*The '))) AS BIGINT) AS n FROM documents GROUP BY doc_id, source)
    SELECT count(*) AS modules, count(*) FILTER (bad = 0) AS modules_ok, CAST(sum(n) FILTER (bad = 0) AS BIGINT) AS proved, CAST(sum(n) AS BIGINT) AS counted FROM m""",
)
def proved_inventory(spark, sf):
    """Documents as modules, the lines that open with a given word as theorems."""
    status = F.when(F.col("doc_id") % 5 == 0, "FAIL").otherwise("OK")
    modules = table(spark, sf, "documents").select(F.col("doc_id").alias("module"), status.alias("status"), "text")
    return ledger.proved_inventory(modules, r"(?m)^\s*The ")
