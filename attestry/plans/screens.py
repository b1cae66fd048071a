"""Specification screening, integrity and assurance bound to documents, customers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import assurance as A
from attestry.operators import integrity, ledger, specs
from attestry.operators import ast_tables
from attestry.plans import corpus
from attestry.plans.ast import WITH_STATS
from attestry.plans.corpus import HOLE_LENGTH, WITH_FUNCS
from attestry.plans.registry import query, table
from attestry.session import spread

# ---- H: a specification per document, a theorem per line; the length of the line decides what is wrong with it


def _pick(n, texts: list[str]):
    return F.element_at(F.array(*map(F.lit, texts)), (n + 1).cast("int"))


def _theorem_text(line, j, doc_id):
    n = F.length(line)
    f, ax = F.concat(F.lit("f"), doc_id), F.concat(F.lit("ax"), doc_id)
    hyp = _pick(n % 7, ["x < 0", "3 = 4", "x ≠ x", "x < 5", "5 < x", "False", "x = y"])
    hyp2 = _pick(n % 3, ["4 < x", "¬(x = y)", "x = y"])
    conclusion = (
        F.when(n % 5 == 0, "True").when(n % 5 == 1, F.concat(f, F.lit(" x = "), f, F.lit(" x")))
        .when(n % 5 == 2, F.concat(f, F.lit(" x = y"))).when(n % 5 == 3, "g x = z").otherwise(F.concat(ax, F.lit(" x ≤ z")))
    )
    proof = F.when(n % 4 == 0, " := rfl\n").otherwise(" := by sorry\n")
    extra = F.when(n % 13 == 0, " (e : Fin 0)").otherwise("")
    statement = F.concat(F.lit(" (x y z : Nat)"), extra, F.lit(" (h : "), hyp, F.lit(") (k : "), hyp2, F.lit(") : "), conclusion)
    return F.concat(F.lit("theorem t"), j, F.when(n % 11 == 0, "").otherwise(statement), proof)


def _problems(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    prose = F.replace(F.replace("text", F.lit("/-"), F.lit("")), F.lit("-/"), F.lit(""))
    theorems = F.transform(F.split("text", "\n", -1), lambda line, j: _theorem_text(line, j, F.col("doc_id")))
    spec = F.concat(F.lit("/- "), prose, F.lit(" -/\naxiom ax"), "doc_id", F.lit(" : Nat → Nat -- see theorem t0 : True\n"), F.array_join(theorems, ""))
    impl = F.concat(F.lit("def f"), "doc_id", F.lit(" (x : Nat) : Nat := x\ndef s"), "doc_id", F.lit(" : Nat := sorry\n"))
    return docs.select(
        F.col("doc_id").cast("string").alias("problem_id"), spec.alias("spec"), impl.alias("impl"), F.col("source").alias("repo"),
        (F.col("doc_id") % 3 == 0).alias("is_canonical"),
        F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 4 == 1).alias("claims_invokes_impl"),
    )


_TH = """th AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS problem_id, source AS repo, i - 1 AS j, length(ls[i]) AS n, doc_id % 3 = 0 AS is_canonical,
           CASE WHEN doc_id % 4 <> 0 THEN doc_id % 4 = 1 END AS claim
    FROM (SELECT *, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
  ck AS (
    SELECT *, n % 11 <> 0 AS analyzed, n % 11 <> 0 AND n % 5 IN (1, 2) AS mentions, CASE WHEN n % 11 = 0 THEN [] ELSE [x FOR x IN [
      CASE WHEN n % 5 IN (0, 3, 4) THEN 'dependency_vacuity:high' END, CASE WHEN n % 13 = 0 OR n % 7 = 5 THEN 'empty_quantification:high' END,
      CASE WHEN n % 4 = 0 THEN 'no_sorry_obligation:low' END, CASE WHEN n % 5 = 4 THEN 'opaque_subject:high' END,
      CASE WHEN n % 5 = 1 THEN 'reflexive_conclusion:high' END, CASE WHEN n % 5 = 0 THEN 'trivial_conclusion:high' END,
      CASE WHEN n % 7 IN (0, 1, 2, 5) OR (n % 7 = 3 AND n % 3 = 0) OR (n % 7 = 6 AND n % 3 = 1) THEN 'unsatisfiable_hypotheses:high' END] IF x IS NOT NULL] END AS fs FROM th),
  sc AS (SELECT *, CASE WHEN NOT analyzed THEN 'not_analyzed' WHEN len(fs) > 0 THEN 'flagged' ELSE 'clean_static' END AS status FROM ck),
  pb AS (SELECT problem_id, repo, is_canonical, claim, count(*) AS found, count(*) FILTER (analyzed) AS analyzed, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (n % 4 <> 0) AS sorries,
      bool_or(analyzed AND NOT mentions) AS misses, CASE WHEN count(*) FILTER (analyzed) = 0 THEN 'not_analyzed' WHEN count(*) FILTER (status = 'flagged') > 0 THEN 'flagged' ELSE 'clean_static' END AS status FROM sc GROUP BY ALL)"""


def _screened(spark, sf):
    return specs.screen(specs.split_theorems(_problems(spark, sf)))


def _problem_statuses(spark, sf):
    return specs.problem_status(_screened(spark, sf))


@query(
    "h_split_theorems",
    f"""WITH {_TH} SELECT problem_id, 't' || j AS name, CASE WHEN analyzed THEN CASE n % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'f' || doc_id || ' x = f' || doc_id || ' x' WHEN 2 THEN 'f' || doc_id || ' x = y' WHEN 3 THEN 'g x = z' ELSE 'ax' || doc_id || ' x ≤ z' END END AS conclusion,
      CASE WHEN analyzed THEN CASE n % 5 WHEN 0 THEN NULL WHEN 4 THEN '≤' ELSE '=' END END AS rel, CASE WHEN analyzed THEN CAST(2 AS BIGINT) END AS n_hyps, n % 4 <> 0 AS has_sorry, analyzed FROM sc""",
)
def split_theorems(spark, sf):
    found = specs.split_theorems(_problems(spark, sf))
    return found.select("problem_id", "name", "conclusion", "rel", F.size("hyps").cast("bigint").alias("n_hyps"), "has_sorry", "analyzed").withColumn(
        "n_hyps", F.when(F.col("n_hyps") >= 0, F.col("n_hyps"))
    )


@query("h_screen", f"WITH {_TH} SELECT problem_id, 't' || j AS name, array_to_string(fs, ',') AS findings, status, mentions AS mentions_impl FROM sc")
def screen(spark, sf):
    """All seven checks and the status of each theorem."""
    listed = F.array_sort(F.transform("findings", lambda f: F.concat_ws(":", f["check"], f["severity"])))
    return _screened(spark, sf).select("problem_id", "name", F.array_join(listed, ",").alias("findings"), "status", "mentions_impl")


@query("h_problem_status", f"WITH {_TH} SELECT problem_id, found AS theorems_found, analyzed AS theorems_analyzed, flagged AS theorems_flagged, sorries AS sorry_placeholders, status FROM pb")
def problem_status(spark, sf):
    return _problem_statuses(spark, sf).select(
        "problem_id", "theorems_found", "theorems_analyzed", "theorems_flagged", F.col("sorry_placeholders").cast("bigint").alias("sorry_placeholders"), "status"
    )


@query(
    "h_screen_summary",
    f"""WITH {_TH} SELECT count(*) AS problems_seen, count(*) FILTER (status = 'not_analyzed') AS problems_not_analyzed, count(*) FILTER (status = 'flagged') AS problems_flagged,
      count(*) FILTER (status = 'clean_static') AS problems_clean_static, count(*) FILTER (status <> 'not_analyzed') AS problems_analyzed, CAST(sum(found - analyzed) AS BIGINT) AS theorems_not_analyzed, CAST(sum(found) AS BIGINT) AS theorems_seen, CAST(sum(analyzed) AS BIGINT) AS theorems_analyzed, CAST(sum(flagged) AS BIGINT) AS theorems_flagged,
      CAST(sum(sorries) AS BIGINT) AS sorry_placeholders, count(*) FILTER (is_canonical) AS canonical_problems, count(*) FILTER (is_canonical AND status = 'flagged') AS canonical_flagged, count(DISTINCT repo) AS distinct_repos FROM pb""",
)
def screen_summary(spark, sf):
    return specs.screen_summary(_problem_statuses(spark, sf))


@query(
    "h_checks_fired",
    f"""WITH {_TH}, x AS (SELECT problem_id, split_part(unnest(fs), ':', 1) AS "check" FROM sc)
    SELECT c."check", count(DISTINCT problem_id) AS problems, count(problem_id) AS theorems
    FROM (SELECT unnest(['dependency_vacuity', 'opaque_subject', 'trivial_conclusion', 'reflexive_conclusion', 'unsatisfiable_hypotheses', 'empty_quantification', 'no_sorry_obligation']) AS "check") c
    LEFT JOIN x USING ("check") GROUP BY ALL""",
)
def checks_fired(spark, sf):
    return specs.checks_fired(_problem_statuses(spark, sf))


@query(
    "h_flagged_repos",
    f"""WITH {_TH}, c AS (SELECT repo AS label, count(*) AS n FROM pb WHERE status = 'flagged' GROUP BY repo), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rank FROM c)
    SELECT label, n, rank FROM r WHERE rank <= 5 UNION ALL SELECT NULL, count(*) - 5, 6 FROM r HAVING count(*) > 5""",
)
def flagged_repos(spark, sf):
    return specs.flagged_repos(_problem_statuses(spark, sf), top=5).withColumn("rank", F.col("rank").cast("bigint"))


@query("h_claim_agreement", f"WITH {_TH} SELECT claim AS dataset, NOT misses AS gate, count(*) AS n FROM pb WHERE status <> 'not_analyzed' AND claim IS NOT NULL GROUP BY ALL")
def claim_agreement(spark, sf):
    return specs.claim_agreement(_problem_statuses(spark, sf))


_SWEEP = """src AS (SELECT doc_id, source, '-- the la' || chr(10) || regexp_replace(text, '["/-]', '', 'g') AS t FROM documents),
  sl AS (SELECT doc_id, source, i AS line, string_split(t, chr(10))[i] AS l FROM (SELECT *, unnest(range(2, len(string_split(t, chr(10))) + 1)) AS i FROM src)),
  hits AS (SELECT doc_id, source, line, 'the' AS kind, (length(l) - length(replace(l, 'the', ''))) // 3 AS n FROM sl UNION ALL SELECT doc_id, source, line, 'la', (length(l) - length(replace(l, 'la ', ''))) // 3 FROM sl)"""


def _sweep(spark, sf):
    """Quotes, slashes and dashes are taken out of the text; a comment holding both tokens opens it."""
    clean = F.concat(F.lit('-- the la\n'), F.regexp_replace("text", '["/-]', ""))
    sources = spread(table(spark, sf, "documents")).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), clean.alias("text"))
    return specs.escape_sweep(sources, {"the": "the", "la": "la "}, demonstrations=["1", "2"])


@query("h_escape_sweep", f"WITH {_SWEEP} SELECT source || '/' || doc_id AS path, kind, CAST(line AS BIGINT) AS line, CAST(n AS BIGINT) AS n, doc_id IN (1, 2) AS demonstration FROM hits WHERE n > 0")
def escape_sweep(spark, sf):
    return _sweep(spark, sf).groupBy("path", "kind", F.col("line").cast("bigint").alias("line"), "demonstration").agg(F.count("*").alias("n"))


@query("h_escape_summary", f"WITH {_SWEEP} SELECT kind, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (starts_with(source, 'src1')), 0) AS BIGINT) AS in_core FROM hits GROUP BY kind HAVING sum(n) > 0")
def escape_summary(spark, sf):
    return specs.escape_summary(_sweep(spark, sf), "src1").drop("failing")


@query(
    "h_doc_figures",
    """SELECT CAST(doc_id AS VARCHAR) AS doc, CASE WHEN doc_id % 13 <> 0 THEN n_chars END AS quoted,
      CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'pattern no longer matches' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS finding FROM documents""",
)
def doc_figures(spark, sf):
    docs = table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    texts = docs.select("path", F.concat(F.lit("This text has "), "n_chars", F.lit(" chars.\n"), "text").alias("text"))
    pattern = F.when(F.col("doc_id") % 13 == 0, r"holds (\d+) glyphs").otherwise(r"has (\d+) chars")
    rules = docs.select(F.col("path").alias("doc"), pattern.alias("pattern"), F.concat(F.lit("a"), "path").alias("artifact"), F.lit("n").alias("key"))
    off = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    metrics = docs.where("doc_id % 11 <> 0").select(F.concat(F.lit("a"), "path").alias("artifact"), F.lit("n").alias("key"), (F.col("n_chars") + off).alias("value"))
    return specs.doc_figures(texts, rules, metrics).select("doc", "quoted", "finding")


# ---- I: documents as artifacts


def _artifacts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("a"), "doc_id").alias("artifact"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("i_digest", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents")
def digest(spark, sf):
    return integrity.digest(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))


@query(
    "i_tree_digest",
    """WITH f AS (SELECT lang AS root, CASE WHEN doc_id % 10 = 0 THEN '.git/' ELSE '' END || source || '/d' || doc_id AS rel, sha256(text) AS sha FROM documents)
    SELECT root, 'tree-sha256:' || sha256(string_agg(rel || chr(0) || sha || chr(10), '' ORDER BY string_split(rel, '/'))) || ':' || count(*) || 'files' AS digest, count(*) AS files
    FROM f WHERE NOT starts_with(rel, '.git/') GROUP BY root""",
)
def tree_digest(spark, sf):
    skipped = F.when(F.col("doc_id") % 10 == 0, ".git/").otherwise("")
    files = table(spark, sf, "documents").select(
        F.col("lang").alias("root"), F.concat(skipped, "source", F.lit("/d"), "doc_id").alias("rel"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    )
    return integrity.tree_digest(files)


_PROV = """pv AS (SELECT doc_id, 'a' || doc_id AS artifact, CASE
      WHEN doc_id % 20 = 0 THEN 'coverage' WHEN doc_id % 20 = 1 THEN '' WHEN doc_id % 20 = 2 THEN 'baseline-expired' WHEN doc_id % 20 = 3 THEN 'fields' WHEN doc_id % 20 = 4 THEN 'unreadable'
      WHEN doc_id % 20 = 19 THEN 'orphan'
      ELSE array_to_string([x FOR x IN [CASE WHEN doc_id % 20 = 5 THEN 'integrity' END, CASE WHEN doc_id % 20 IN (5, 6) THEN 'pin' END, CASE WHEN doc_id % 20 = 7 THEN 'exporter-missing' END, CASE WHEN doc_id % 20 = 8 THEN 'exporter-drift' END, CASE WHEN doc_id % 20 = 9 THEN 'source-moved' END] IF x IS NOT NULL], ',') END AS findings FROM documents),
  ps AS (SELECT *, CASE WHEN doc_id % 20 IN (0, 2, 3, 4, 19) THEN 'violation' WHEN doc_id % 20 = 1 THEN 'baselined' ELSE 'attributed' END AS state FROM pv)"""


def _audited(spark, sf):
    all_rows = _artifacts(spark, sf)
    case = F.col("doc_id") % 20
    records = all_rows.where(~case.isin(0, 1, 2)).select(
        "artifact", F.when(case == 5, "other").otherwise(F.col("sha256")).alias("artifact_sha256"), F.when(case.isin(5, 6), "v2").otherwise("v1").alias("parser_version"),
        F.when(case == 7, "gone").when(case == 8, "old").otherwise("exp").alias("exporter"), F.lit("e1").alias("exporter_sha256"),
        F.concat(F.lit("/src/"), F.col("doc_id") % 50).alias("source_path"), F.when(case == 9, "r0").otherwise("r1").alias("source_revision"),
        F.when(case != 3, "run").alias("command"), F.lit(1).alias("schema_version"), (case == 4).alias("unreadable"), F.col("artifact").alias("recorded_artifact"),
    )
    baseline = all_rows.where(case.isin(1, 2)).select("artifact", F.when(case == 1, F.col("sha256")).otherwise("stale").alias("artifact_sha256"), F.lit("older than recording").alias("reason"))
    exporters = spark.createDataFrame([("exp", "e1"), ("old", "e2")], "exporter STRING, sha256 STRING")
    sources = all_rows.select(F.concat(F.lit("/src/"), F.col("doc_id") % 50).alias("source_path")).distinct().withColumn("revision", F.lit("r1"))
    return integrity.audit_provenance(all_rows.where(case != 19), records, baseline, exporters, "v1", sources)


@query("i_audit_provenance", f"WITH {_PROV} SELECT artifact, state, findings FROM ps")
def audit_provenance(spark, sf):
    return _audited(spark, sf).select("artifact", "state", F.array_join("findings", ",").alias("findings"))


@query(
    "i_provenance_summary",
    f"""WITH {_PROV} SELECT count(*) FILTER (findings <> 'orphan') AS artifacts, count(*) FILTER (state = 'attributed') AS attributed, count(*) FILTER (state = 'baselined') AS baselined,
      CAST(sum(CASE WHEN findings = '' THEN 0 ELSE len(string_split(findings, ',')) END) AS BIGINT) AS violations, 'FAIL' AS outcome FROM ps""",
)
def provenance_summary(spark, sf):
    return integrity.provenance_summary(_audited(spark, sf))


_CHANGES = """ch AS (SELECT lang AS module, 'd' || doc_id AS name, CASE WHEN doc_id % 10 = 0 THEN 'only_first' WHEN doc_id % 10 = 1 THEN 'only_second' WHEN doc_id % 7 = 0 THEN 'body_differs' ELSE 'same' END AS change FROM documents)"""


def _changes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("module"), F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("body"))
    changed = docs.withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return integrity.diff_corpora(docs.where("doc_id % 10 <> 1"), changed.where("doc_id % 10 <> 0"))


@query("i_diff_corpora", f"WITH {_CHANGES} SELECT * FROM ch")
def diff_corpora(spark, sf):
    return _changes(spark, sf)


@query(
    "i_diff_summary",
    f"""WITH {_CHANGES} SELECT module, count(*) FILTER (change = 'only_first') AS only_first, count(*) FILTER (change = 'only_second') AS only_second, count(*) FILTER (change = 'body_differs') AS body_differs,
      count(*) FILTER (change = 'same') AS same FROM ch GROUP BY module""",
)
def diff_summary(spark, sf):
    return integrity.diff_summary(_changes(spark, sf))


@query(
    "i_spec_freshness",
    """SELECT 's' || doc_id AS spec, CASE WHEN doc_id % 6 = 0 THEN 'unchecked' WHEN doc_id % 6 = 1 THEN 'unpinned' WHEN doc_id % 6 = 2 THEN 'stale' ELSE 'ok' END AS status FROM documents""",
)
def spec_freshness(spark, sf):
    rows, case = _artifacts(spark, sf), F.col("doc_id") % 6
    pinned = rows.select(F.concat(F.lit("s"), "doc_id").alias("spec"), F.col("artifact").alias("corpus"), F.when(case == 2, "old").when(case != 1, F.col("sha256")).alias("pinned"))
    now = rows.where(case != 0).select(F.col("artifact").alias("corpus"), F.when(case != 3, F.col("sha256")).alias("sha256"), F.col("sha256").alias("recorded"))
    return integrity.spec_freshness(pinned, now).select("spec", "status")


_MANIFEST = """mv AS (SELECT 'a' || doc_id AS module, CASE doc_id % 7 WHEN 0 THEN 'UNVERIFIABLE' WHEN 1 THEN 'UNVERIFIABLE' WHEN 2 THEN 'MISMATCH' WHEN 3 THEN 'UNVERIFIABLE' WHEN 4 THEN 'MISMATCH' WHEN 5 THEN 'MISMATCH' ELSE 'OK' END AS verdict,
      CASE doc_id % 7 WHEN 0 THEN 'AST not found' WHEN 1 THEN 'no digest recorded' WHEN 2 THEN 'AST changed' WHEN 3 THEN 'no render' WHEN 4 THEN 'render changed' WHEN 5 THEN 'live copy is not the render' ELSE '' END AS detail FROM documents)"""


def _manifest(spark, sf):
    rows, case = _artifacts(spark, sf).withColumnRenamed("artifact", "module"), F.col("doc_id") % 7
    manifest = rows.select("module", F.when(case == 2, "old").when(case != 1, F.col("sha256")).alias("ast_sha256"), F.when(case == 4, "old").otherwise("r").alias("render_sha256"))
    renders = rows.where(case != 3).select("module", F.lit("r").alias("sha256"))
    live = rows.where("doc_id % 2 = 0 OR doc_id % 7 = 5").select("module", F.when(case == 5, "edited").otherwise("r").alias("sha256"))
    return integrity.manifest_verdict(manifest, rows.where(case != 0), renders, live)


@query("i_manifest_verdict", f"WITH {_MANIFEST} SELECT * FROM mv")
def manifest_verdict(spark, sf):
    return _manifest(spark, sf)


@query("i_exit_class", f"WITH {_MANIFEST} SELECT CASE WHEN count(*) FILTER (verdict = 'MISMATCH') > 0 THEN 1 WHEN count(*) FILTER (verdict = 'OK') = 0 THEN 2 WHEN count(*) FILTER (verdict = 'UNVERIFIABLE') > 0 THEN 3 ELSE 0 END AS exit_class FROM mv")
def exit_class(spark, sf):
    return integrity.exit_class(_manifest(spark, sf))


@query(
    "i_validate_contract",
    f"""WITH {WITH_STATS}, fc AS (SELECT module, count(*) AS n, count(*) FILTER (file LIKE '%.txt') AS bad FROM funcs GROUP BY module),
    nd AS (SELECT f.module, CAST(sum(matrix_nodes) AS BIGINT) AS n FROM stats JOIN funcs f USING (doc_id) GROUP BY f.module),
    h AS (SELECT module, count(*) FILTER (n >= {HOLE_LENGTH}) AS holes, count(*) FILTER (n < {HOLE_LENGTH} AND n % 7 IN (3, 6)) AS ints, count(*) FILTER (n < {HOLE_LENGTH} AND n % 7 = 2) AS strs FROM words GROUP BY module),
    l AS (SELECT module, count(*) FILTER (len(ws) % 5 = 4) AS ints FROM lines GROUP BY module),
    a AS (SELECT nd.module, nd.n, coalesce(h.holes, 0) AS holes, coalesce(h.ints, 0) + coalesce(l.ints, 0) AS ints, coalesce(h.strs, 0) AS strs
      FROM nd LEFT JOIN h ON h.module IS NOT DISTINCT FROM nd.module LEFT JOIN l ON l.module IS NOT DISTINCT FROM nd.module)
    SELECT module, 'required_fields' AS rule, n AS checked, CAST(0 AS BIGINT) AS violations, false AS failed FROM fc
    UNION ALL SELECT module, 'known_extension', n, bad, bad > 0 FROM fc
    UNION ALL SELECT module, unnest(['hole_label', 'label_namespaced']), holes, 0, holes = 0 FROM a
    UNION ALL SELECT module, 'int_exact', ints, 0, ints = 0 FROM a
    UNION ALL SELECT module, 'str_literal', strs, 0, false FROM a
    UNION ALL SELECT module, unnest(['int_canonical', 'bool_literal', 'import_vocabulary']), 0, 0, false FROM a
    UNION ALL SELECT module, unnest(['known_kind', 'unquoted_literals']), n, 0, n = 0 FROM a""",
)
def validate_contract(spark, sf):
    """All eleven rules; the corpus holds no text integers, booleans or import labels, so these check nothing."""
    nodes = corpus.nodes(spark, sf, ["k", "v", "v_type", "label"])
    return integrity.validate_contract(corpus.functions(spark, sf), nodes)


@query(
    "i_cross_check",
    """SELECT 'f' || doc_id AS fact, CAST(2 AS BIGINT) AS artifacts, CASE WHEN doc_id % 5 = 0 THEN 'absent' WHEN doc_id % 4 = 0 THEN 'disagree' ELSE 'ok' END AS finding FROM documents""",
)
def cross_check(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("fact"), "n_chars")
    a = docs.select("fact", F.lit("ledger").alias("artifact"), F.col("n_chars").alias("value"))
    b = docs.where("doc_id % 5 <> 0").select("fact", F.lit("ast").alias("artifact"), (F.col("n_chars") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("value"))
    required = docs.select("fact", F.explode(F.array(F.lit("ledger"), F.lit("ast"))).alias("artifact"))
    return integrity.cross_check(a.unionByName(b), required).select("fact", "artifacts", "finding")


# ---- J: customers as modules, their orders as the evidence


def _rank(s: str) -> str:
    return f"(CASE {s} WHEN 'SUPPORTED' THEN 3 WHEN 'WEAK' THEN 2 WHEN 'UNSUPPORTED' THEN 1 ELSE 0 END)"


def _at_most(s: str, cap: str) -> str:
    return f"(CASE WHEN {_rank(s)} <= {_rank(cap)} THEN {s} ELSE {cap} END)"


def _cap(s: str, covered: str, population: str) -> str:
    cap = f"(CASE WHEN {covered} >= {population} THEN 'SUPPORTED' WHEN {covered}::DOUBLE / {population} >= 0.8 THEN 'WEAK' ELSE 'UNSUPPORTED' END)"
    return f"(CASE WHEN {population} = 0 THEN {s} ELSE {_at_most(s, cap)} END)"


def _worst(*ss: str) -> str:
    low = f"least({', '.join(_rank(s) for s in ss)})"
    beaten = " OR ".join(f"{s} = 'DEFEATED'" for s in ss)
    return f"(CASE {low} WHEN 3 THEN 'SUPPORTED' WHEN 2 THEN 'WEAK' WHEN 1 THEN 'UNSUPPORTED' ELSE CASE WHEN {beaten} THEN 'DEFEATED' ELSE 'UNDEVELOPED' END END)"


# Per customer: orders (population), finished ones (covered), how many of the covered agree, and what is missing.
_MOD = """md AS (
    SELECT c_custkey AS k, 'M' || c_custkey AS module, count(o_orderkey) AS population, count(*) FILTER (o_orderstatus <> 'P' OR c_custkey % 3 = 0) - CASE WHEN count(o_orderkey) = 0 AND (c_custkey % 3 = 0) THEN 1 ELSE 0 END AS covered,
      count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_totalprice > 400000) AS big FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
  m AS (SELECT *, k % 17 <> 0 AS present, CASE WHEN k % 13 = 1 THEN NULL WHEN k % 13 = 2 THEN 'other' ELSE module END AS tag, CASE WHEN k % 5 = 0 THEN big ELSE 0 END AS div, covered AS total FROM md)"""


def _modules(spark, sf):
    orders = table(spark, sf, "orders")
    k = F.col("c_custkey")
    has = F.col("o_orderkey").isNotNull()
    base = table(spark, sf, "customer").join(orders, k == F.col("o_custkey"), "left").groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("population"), F.count_if(has & ((F.col("o_orderstatus") != "P") | (k % 3 == 0))).alias("covered"),
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_totalprice") > 400000).alias("big"),
    )
    module = F.concat(F.lit("M"), k)
    return base.select(
        k.alias("k"), module.alias("module"), "population", "covered", "f", "big", (k % 17 != 0).alias("present"),
        F.when(k % 13 == 2, "other").when(k % 13 != 1, module).alias("tag"), F.when(k % 5 == 0, F.col("big")).otherwise(0).alias("divergences"),
        F.col("covered").alias("total"),
    )


@query("j_coverage_cap", f"WITH {_MOD} SELECT module, {_cap(chr(39) + 'SUPPORTED' + chr(39), 'covered', 'population')} AS status FROM m")
def coverage_cap(spark, sf):
    return _modules(spark, sf).select("module", A.coverage_cap(F.lit("SUPPORTED"), F.col("covered"), F.col("population")).alias("status"))


@query(
    "j_weakest",
    f"""WITH s AS (SELECT o_custkey AS module, CASE WHEN o_orderkey % 41 = 0 THEN 'DEFEATED' WHEN o_orderkey % 23 = 0 THEN 'UNDEVELOPED' WHEN o_orderkey % 11 = 0 THEN 'UNSUPPORTED' WHEN o_orderkey % 3 = 0 THEN 'WEAK' ELSE 'SUPPORTED' END AS status FROM orders)
    SELECT module, CASE min({_rank('status')}) WHEN 3 THEN 'SUPPORTED' WHEN 2 THEN 'WEAK' WHEN 1 THEN 'UNSUPPORTED' ELSE CASE WHEN bool_or(status = 'DEFEATED') THEN 'DEFEATED' ELSE 'UNDEVELOPED' END END AS status FROM s GROUP BY module""",
)
def weakest(spark, sf):
    status = F.expr("CASE WHEN o_orderkey % 41 = 0 THEN 'DEFEATED' WHEN o_orderkey % 23 = 0 THEN 'UNDEVELOPED' WHEN o_orderkey % 11 = 0 THEN 'UNSUPPORTED' WHEN o_orderkey % 3 = 0 THEN 'WEAK' ELSE 'SUPPORTED' END")
    return A.weakest(table(spark, sf, "orders").select(F.col("o_custkey").alias("module"), status.alias("status")), ["module"])


_FAITH = f"""fa AS (SELECT *, present AND tag IS NOT NULL AND tag <> module AS off, CASE WHEN total = 0 THEN 'UNSUPPORTED' WHEN div > 0 THEN 'DEFEATED' ELSE 'SUPPORTED' END AS base FROM m),
  fb AS (SELECT *, CASE WHEN off THEN 'UNDEVELOPED' WHEN tag IS NULL THEN {_at_most('base', "'WEAK'")} ELSE base END AS cs, CASE WHEN off THEN 0 ELSE covered END AS cov, CASE WHEN off THEN 0 ELSE population END AS pop FROM fa),
  fc AS (SELECT *, CASE WHEN pop > cov THEN {_worst('cs', "'UNDEVELOPED'")} ELSE cs END AS legs FROM fb),
  g2 AS (SELECT module, CASE WHEN NOT present THEN 'UNDEVELOPED' ELSE {_cap('legs', 'cov', 'pop')} END AS g2, present, off, cs, cov, pop, total FROM fc)"""


@query(
    "j_leg_faithfulness",
    f"""WITH {_MOD}, {_FAITH} SELECT module, 'G2' AS id, g2 AS status, CASE WHEN present THEN 'TEST' END AS evidence_kind, cov AS covered, pop AS population FROM g2
    UNION ALL SELECT module, 'G2.1', cs, 'TEST', cov, pop FROM g2 WHERE present AND NOT off
    UNION ALL SELECT module, 'G2.2', 'UNDEVELOPED', NULL, 0, pop - cov FROM g2 WHERE present AND pop > cov
    UNION ALL SELECT module, 'D1', 'UNSUPPORTED', NULL, NULL, NULL FROM g2 WHERE present AND total = 0
    UNION ALL SELECT module, 'D2', 'UNSUPPORTED', NULL, NULL, NULL FROM g2 WHERE present AND total > 0 AND pop > 0 AND cov < pop""",
)
def leg_faithfulness(spark, sf):
    agree = F.col("total") - F.col("divergences")
    return A.leg_faithfulness(_modules(spark, sf).withColumn("agree", agree))


_COV = f"""cv AS (SELECT *, k % 19 <> 0 AS ast, population - covered AS holes, k % 4 <> 0 AS led, k % 6 = 1 AS orc, CASE WHEN k % 8 = 1 THEN 0 ELSE 5 END AS risk FROM m),
  cw AS (SELECT *, CASE WHEN NOT ast THEN 'UNDEVELOPED' WHEN holes = 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS g3, CASE WHEN (CASE WHEN led THEN f ELSE covered END) > 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS c0, led AND risk = 0 AS safe FROM cv),
  cx AS (SELECT *, CASE WHEN led THEN c0 ELSE {_worst('c0', "'WEAK'")} END AS g31, CASE WHEN orc THEN CASE WHEN f = CASE WHEN covered = 0 THEN population ELSE covered END THEN 'SUPPORTED' ELSE 'DEFEATED' END WHEN safe THEN 'SUPPORTED' ELSE {_cap("'WEAK'", 'big', 'population')} END AS g32 FROM cw)"""


def _coverage_facts(spark, sf):
    k = F.col("k")
    return _modules(spark, sf).select(
        "module", "k", (k % 19 != 0).alias("ast_present"), F.col("population").alias("functions"), F.col("covered").alias("hole_free"), (F.col("population") - F.col("covered")).alias("holes"),
        (k % 4 != 0).alias("ledger_present"), F.col("f").alias("core"), F.when(k % 8 == 1, 0).otherwise(5).alias("risk"), F.col("big").alias("exec_covered"),
        (k % 6 == 1).alias("oracle_present"), F.col("covered").alias("claimed"), F.col("f").alias("survived"), (F.col("covered") - F.col("f")).alias("refuted"),
    )


@query(
    "j_leg_coverage",
    f"""WITH {_MOD}, {_COV} SELECT module, 'G3' AS id, g3 AS status, CAST(NULL AS VARCHAR) AS evidence_kind, covered, population FROM cx
    UNION ALL SELECT module, 'G3.1', g31, 'STATIC', CASE WHEN led THEN f ELSE covered END, population FROM cx WHERE ast
    UNION ALL SELECT module, 'G3.2', g32, CASE WHEN safe THEN 'STATIC' ELSE 'TEST' END, big, population FROM cx WHERE ast
    UNION ALL SELECT module, 'D3', 'UNSUPPORTED', NULL, NULL, NULL FROM cx WHERE ast AND g32 <> 'SUPPORTED'
    UNION ALL SELECT module, 'D3.1', 'DEFEATED', 'TEST', NULL, NULL FROM cx WHERE ast AND orc AND covered - f > 0""",
)
def leg_coverage(spark, sf):
    return A.leg_coverage(_coverage_facts(spark, sf))


_CONTRACTS = """ct AS (SELECT 'M' || c_custkey AS module, CASE WHEN o_orderkey IS NOT NULL THEN 'Spec.Thm.t' || o_orderkey END AS theorem, coalesce(o_orderkey % 6 <> 0, false) AS sat, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey)"""


def _contracts(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    link = F.struct(F.concat(F.lit("ext call "), F.col("o_orderkey") % 3).alias("label"), F.lit("holds").alias("statement"), F.lit(8).alias("fuelBound"))
    return joined.select(
        F.concat(F.lit("M"), "c_custkey").alias("module"), F.when(F.col("o_orderkey").isNotNull(), F.concat(F.lit("Spec.Thm.t"), "o_orderkey")).alias("theorem"),
        (F.col("o_orderkey") % 6 != 0).alias("satisfiable"), F.when(F.col("o_orderkey").isNotNull(), F.array(link)).alias("relative_to"),
    )


@query(
    "j_leg_contracts",
    f"""WITH {_CONTRACTS} SELECT module, 'G.CONTRACT.t' || o_orderkey AS id, CASE WHEN sat THEN 'SUPPORTED' ELSE 'DEFEATED' END AS status FROM ct WHERE theorem IS NOT NULL
    UNION ALL SELECT module, 'G.CONTRACT', CASE WHEN count(theorem) = 0 THEN 'UNDEVELOPED' WHEN count(*) FILTER (theorem IS NOT NULL AND NOT sat) > 0 THEN 'DEFEATED' ELSE 'SUPPORTED' END FROM ct GROUP BY module""",
)
def leg_contracts(spark, sf):
    return A.leg_contracts(_contracts(spark, sf)).select("module", "id", "status")


@query("j_contract_assumptions", f"WITH {_CONTRACTS} SELECT module, 'A.t' || o_orderkey || '.ext-call-' || (o_orderkey % 3) AS id, theorem FROM ct WHERE theorem IS NOT NULL")
def contract_assumptions(spark, sf):
    return A.contract_assumptions(_contracts(spark, sf)).select("module", "id", "theorem")


_ADEQ = "ad AS (SELECT module, present AND tag = module AS usable, f, big FROM m), g4 AS (SELECT module, CASE WHEN NOT coalesce(usable, false) OR f + big = 0 THEN 'UNDEVELOPED' WHEN big = 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS g4, coalesce(usable, false) AS usable, f, big FROM ad)"


@query("j_leg_adequacy", f"WITH {_MOD}, {_ADEQ} SELECT module, 'G4' AS id, g4 AS status, CASE WHEN usable THEN 'TEST' END AS evidence_kind, CASE WHEN usable THEN f ELSE 0 END AS covered, CASE WHEN usable THEN f + big ELSE 0 END AS population FROM g4")
def leg_adequacy(spark, sf):
    return A.leg_adequacy(_modules(spark, sf).select("module", "present", "tag", F.col("f").alias("killed"), F.col("big").alias("survived")))


_VALID = f"""va AS (SELECT module, k % 29 <> 0 AS pres, k % 6 = 0 AS bad, f AS theorems, k % 2 = 0 AS wide FROM m),
  vb AS (SELECT *, CASE WHEN bad THEN 'DEFEATED' WHEN theorems > 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS own FROM va),
  g5 AS (SELECT *, CASE WHEN NOT pres THEN 'UNDEVELOPED' WHEN wide AND NOT bad THEN {_at_most('own', "'WEAK'")} ELSE own END AS g5 FROM vb)"""


def _axioms(spark, sf):
    k = F.col("k")
    return _modules(spark, sf).select(
        "module", (k % 29 != 0).alias("present"), F.when(k % 6 == 0, F.array(F.lit("sorryAx"))).otherwise(F.array(F.lit("propext"))).alias("axioms"),
        F.array().cast("array<string>").alias("leaks"), F.col("f").alias("theorems"), (k % 2 == 0).alias("repo_wide"),
    )


@query("j_leg_validity", f"WITH {_MOD}, {_VALID} SELECT module, 'G5' AS id, g5 AS status, CASE WHEN pres THEN 'PROOF' END AS evidence_kind, theorems AS covered, theorems AS population FROM g5 UNION ALL SELECT module, 'G5.1', own, 'PROOF', theorems, theorems FROM g5 WHERE pres AND wide")
def leg_validity(spark, sf):
    return A.leg_validity(_axioms(spark, sf))


def _all_claims(spark, sf):
    modules = _modules(spark, sf)
    agree = F.col("total") - F.col("divergences")
    adequacy = modules.select("module", "present", "tag", F.col("f").alias("killed"), F.col("big").alias("survived"))
    return (
        A.leg_faithfulness(modules.withColumn("agree", agree))
        .unionByName(A.leg_coverage(_coverage_facts(spark, sf)))
        .unionByName(A.leg_adequacy(adequacy))
        .unionByName(A.leg_validity(_axioms(spark, sf)))
    )


_TOP0 = _worst("g2", "g3", "g4", "g5")


@query(
    "j_roll_up",
    f"""WITH {_MOD}, {_FAITH}, {_COV}, {_ADEQ}, {_VALID}, al AS (SELECT module, g2, g3, g4, g5, g2.present, cx.holes FROM g2 JOIN cx USING (module) JOIN g4 USING (module) JOIN g5 USING (module)),
    t0 AS (SELECT *, {_TOP0} AS w FROM al), t1 AS (SELECT *, CASE WHEN holes > 0 THEN {_worst('w', "'UNSUPPORTED'")} ELSE w END AS w1 FROM t0),
    t2 AS (SELECT *, CASE WHEN present THEN {_worst('w1', "'WEAK'")} ELSE w1 END AS status FROM t1)
    SELECT module, g2 AS "G2", g3 AS "G3", g4 AS "G4", g5 AS "G5", status, status = 'SUPPORTED' AS assertable, concat_ws('; ', CASE WHEN holes > 0 THEN holes || ' unresolved holes carried as assumptions' END,
      CASE WHEN g2 <> 'SUPPORTED' THEN 'faithfulness not established over the whole module' END, CASE WHEN present THEN 'faithfulness is TESTED, not PROVED' END) AS blockers FROM t2""",
)
def roll_up(spark, sf):
    """The whole assurance case of every module, from four legs."""
    top = A.roll_up(_all_claims(spark, sf), _coverage_facts(spark, sf).select("module", "holes"))
    return top.withColumn("blockers", F.array_join("blockers", "; "))


_ARGUMENT = """l AS (SELECT DISTINCT o_custkey AS module, CASE WHEN o_orderkey % 3 = 0 THEN 'E' ELSE 'D' END || (o_orderkey % 5) AS source, CASE WHEN o_orderstatus = 'F' THEN 'COUNTERS' ELSE 'SUPPORTS' END AS type FROM orders),
  k AS (SELECT module, source, CASE WHEN source LIKE 'E%' AND type = 'SUPPORTS' THEN 'evidence' WHEN source LIKE 'E%' THEN 'counter_evidence' WHEN type = 'COUNTERS' THEN 'defeaters' END AS kind FROM l)"""


def _argument(spark, sf):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "E").otherwise("D")
    links = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("module"), F.concat(kind, F.col("o_orderkey") % 5).alias("source"), F.lit("G").alias("target"),
        F.when(F.col("o_orderstatus") == "F", "COUNTERS").otherwise("SUPPORTS").alias("type"),
    )
    return links.where(F.col("source").startswith("E")).select("module", F.col("source").alias("id")), links


@query(
    "j_argument_edges",
    f"""WITH {_ARGUMENT}, r AS (SELECT *, (row_number() OVER (PARTITION BY module, kind ORDER BY source) - 1) // 2 AS block FROM k WHERE kind IS NOT NULL)
    SELECT module, kind, block, string_agg(source, ',' ORDER BY source) AS sources FROM r GROUP BY ALL""",
)
def argument_edges(spark, sf):
    """Links of each claim in blocks of two."""
    return A.argument_edges(*_argument(spark, sf), size=2).select("module", "kind", "block", F.array_join("sources", ",").alias("sources"))


@query(
    "j_argument_claims",
    f"""WITH {_ARGUMENT} SELECT c_custkey AS module, count(*) FILTER (kind = 'evidence') AS evidence, count(*) FILTER (kind = 'counter_evidence') AS counter_evidence,
      count(*) FILTER (kind = 'defeaters') AS defeaters, c_custkey % 4 = 1 AS undeveloped, c_custkey % 4 = 0 AS defeated FROM customer LEFT JOIN k ON module = c_custkey GROUP BY c_custkey""",
)
def argument_claims(spark, sf):
    status = F.when(F.col("c_custkey") % 4 == 0, "DEFEATED").when(F.col("c_custkey") % 4 == 1, "UNDEVELOPED").otherwise("WEAK")
    claims = table(spark, sf, "customer").select(F.col("c_custkey").alias("module"), F.lit("G").alias("id"), status.alias("status"))
    return A.argument_claims(claims, *_argument(spark, sf)).drop("id", "status")


@query(
    "j_assumptions",
    f"""WITH {WITH_FUNCS} SELECT module, 'A.len:' || n AS id, 'len:' || n AS label, count(*) AS count FROM words WHERE n >= {HOLE_LENGTH} GROUP BY module, n""",
)
def assumptions(spark, sf):
    found = ast_tables.holes_of(corpus.functions(spark, sf))
    sites = ledger.hole_sites(found)
    return A.assumptions(sites).select("module", "id", "label", "count")


@query("j_subjects", "SELECT lang AS module, 'd' || doc_id AS name, sha256(text) AS sha256 FROM documents WHERE doc_id % 9 <> 0")
def subjects(spark, sf):
    content = F.when(F.col("doc_id") % 9 != 0, F.col("text").cast("binary"))
    files = table(spark, sf, "documents").select(F.col("lang").alias("module"), F.lit("ast").alias("kind"), F.concat("source", F.lit("/d"), "doc_id").alias("path"), content.alias("content"))
    return A.subjects(files).select("module", "name", "sha256")
