"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import conversation_repair, decontamination, embedding_dedup, exact_dedup, language_id, line_dedup, lm_scoring, merkle, ngram_join, packing, pii, secrets, toxicity
from attestry.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@_query(
    "op8_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def _sql_spans(kind: int, pattern: str, group: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, owner, repo, {kind} AS kind, string_split_regex(text, '{pattern}') AS gap,
        regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {group}) AS val FROM t"""


OP2_SQL = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(lang, '') AS repo FROM documents),
    m AS ({_sql_spans(0, secrets.ASSIGN, 2)} UNION ALL {_sql_spans(1, secrets.ACCESS, 0)}
        UNION ALL {_sql_spans(2, secrets.HEX, 0)} UNION ALL {_sql_spans(3, secrets.MIXED, 0)}),
    i AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m WHERE len(whole) > 0),
    x AS (SELECT doc_id, owner, repo, kind, val[i] AS val, len(whole[i]) AS n,
        CAST(list_sum(list_transform(gap[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: len(g))), 0) AS BIGINT) AS s
        FROM i),
    base AS (SELECT * FROM x WHERE kind = 0 AND len(val) >= 12 OR kind IN (1, 2)),
    cand AS (SELECT * FROM base UNION ALL
        SELECT * FROM x WHERE kind = 3 AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]')
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.s + x.n AND x.s < b.s + b.n)),
    held AS (SELECT val, count(DISTINCT owner) >= {secrets.WIDE_OWNERS} OR count(DISTINCT owner || chr(0) || repo) >= {secrets.WIDE_REPOS} AS copied
        FROM cand GROUP BY val),
    judged AS (SELECT c.*, copied, NOT copied AND len(list_distinct(string_split(c.val, ''))) >= {secrets.MIN_DISTINCT}
        AND NOT regexp_matches(c.val, '{secrets.PLACEHOLDER}') AS live,
        ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || (s + n) AS span
        FROM cand c JOIN held USING (val)),
    per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM judged GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
    FROM t LEFT JOIN per USING (doc_id)
    """


@_query("op2_secrets", OP2_SQL)
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner is a source; its repositories are the languages it publishes in."""
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, docs["source"], docs["lang"])


@_query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@_query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@_query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortened texts by their digest."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


OP5_SQL = r"""
    WITH t AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    w AS (SELECT side, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
    s AS (SELECT DISTINCT side, id, array_to_string(ws[i:i + 4], ' ') AS s
        FROM (SELECT side, id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY id)
    SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_item, count(*) AS n_shared
    FROM s d JOIN s b ON d.side = 0 AND b.side = 1 AND d.s = b.s JOIN n ON n.id = b.id
    GROUP BY d.id, b.id, n.n HAVING 100 * count(*) >= 80 * n.n
    """


@_query("op5_decontamination", OP5_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item that it contains."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared")


OP6_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(ws[i:i + 4]) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS r FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.r)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
    FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY a) c ON c.doc_id = w.doc_id
    """


@_query("op6_ngram_join", OP6_SQL)
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
    x AS (SELECT doc_id, i, w AS c FROM t),
    g AS (SELECT doc_id, i, c, lag(c) OVER d AS b, lag(c, 2) OVER d AS a FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    n1 AS (SELECT c, count(*) AS n FROM g GROUP BY c),
    n2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
    n3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
    s AS (SELECT g.doc_id, CASE
            WHEN n3.n >= 2 THEN n3.n / h2.n::DOUBLE
            WHEN n2.n >= 2 THEN n2.n / h1.n::DOUBLE * CASE WHEN g.a IS NULL THEN 1 ELSE 0.4 END
            ELSE n1.n / (SELECT count(*) FROM t)::DOUBLE * CASE WHEN g.b IS NULL THEN 1 WHEN g.a IS NULL THEN 0.4 ELSE 0.4 * 0.4 END END AS p
        FROM g JOIN n1 ON n1.c = g.c LEFT JOIN n1 h1 ON h1.c = g.b LEFT JOIN n2 ON n2.b = g.b AND n2.c = g.c
        LEFT JOIN n2 h2 ON h2.b = g.a AND h2.c = g.b LEFT JOIN n3 ON n3.a = g.a AND n3.b = g.b AND n3.c = g.c),
    m AS (SELECT doc_id, avg(ln(p)) AS mean_log FROM s GROUP BY doc_id)
    SELECT w.doc_id, len(w.ws) AS n_words, round(m.mean_log, 6) AS mean_log FROM w LEFT JOIN m USING (doc_id)
    """


@_query("op7_lm_scoring", OP7_SQL)
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents")).withColumn("mean_log", F.round("mean_log", 6))


@_query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """The crc32 of an ASCII text, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, 3988292384 * (h & 1)) END, 4294967295), 4294967295)"


# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Per row and state the least (cost, audit, lines).
OP11_SQL = rf"""
    WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
    m AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE fate <> 0),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || text, copy) AS i,
        regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM m),
    f AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
    ins AS (SELECT * FROM (VALUES (0, 0, 0, []::VARCHAR[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']),
        (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 2, 3, ['user:', 'assistant:'])) t(came, k, s, made)),
    p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM g
        UNION ALL SELECT conv_id, i, s, min(best) FROM (
            SELECT p.conv_id, f.i, e.s, {{'cost': p.best.cost + 3 * ins.k + e.cost, 'audit': p.best.audit || repeat('I', ins.k) || e.edit, 'lines': list_concat(list_concat(p.best.lines, ins.made), e.line)}} AS best
            FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ins ON ins.came = p.s,
            LATERAL (SELECT 'D' AS edit, ins.s AS s, 4 AS cost, []::VARCHAR[] AS line
                UNION ALL SELECT 'R', CASE ins.s WHEN 2 THEN 3 ELSE 2 END, CASE f.fault WHEN '' THEN 3 ELSE 6 END, [CASE ins.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text] WHERE f.fault IN ('', 'truncated')
                UNION ALL SELECT 'K', CASE f.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE f.fault WHEN '' THEN 0 ELSE 3 END, [f.role || ':' || f.text]
                WHERE f.fault IN ('', 'truncated') AND (f.c = 's' AND ins.s = 0 OR f.c = 'u' AND ins.s <> 2 OR f.c = 'a' AND ins.s = 2)) e) GROUP BY conv_id, i, s),
    w AS (SELECT p.conv_id, min({{'cost': best.cost + [0, 6, 3, 0][s + 1], 'audit': best.audit || ['', 'II', 'I', ''][s + 1],
        'lines': list_concat(best.lines, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}}) AS best
        FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = g.n GROUP BY p.conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
    """


@_query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def _merkle_sql(source_levels: int = 9, top_levels: int = 6) -> str:
    """Level by level, for sources of up to 3 ** source_levels rows."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, levels: int) -> list[str]:
        """From {name}0 (tree, i, d, n) to {name}{levels}, and {name}s{k}, the siblings of each node."""
        ctes = []
        for k in range(levels):
            run = f"SELECT a.tree, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r"
            ctes.append(f"{name}s{k} AS MATERIALIZED ({run} FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.tree, a.i)")
            up = f"SELECT tree, i // 3 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, (n + 2) // 3 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 3, n"
            ctes.append(f"{name}{k + 1} AS MATERIALIZED ({up} UNION ALL SELECT * FROM {name}{k} WHERE n = 1)")
        return ctes

    def walk(name: str, into: str, levels: int) -> list[str]:
        """{into}0 (row, tree, i, f, p): digest and proof so far, taken up all levels."""
        return [
            f"{into}{k + 1} AS (SELECT w.row, w.tree, w.i // 3 AS i, CASE WHEN s.tree IS NULL THEN w.f ELSE sha256(s.l || w.f || s.r) END AS f, "
            f"w.p || coalesce(s.l || s.r, '') AS p FROM {into}{k} w LEFT JOIN {name}s{k} s ON s.tree = w.tree AND s.i = w.i)"
            for k in range(levels)
        ]

    ctes = [
        f"t AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf('text')} AS leaf, {_crc32_sql('doc_id::VARCHAR')} % 2 = 0 AS hit FROM documents)",
        f"""x AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, tree, leaf, CASE WHEN hit THEN {leaf("replace(text, chr(10), '')")} ELSE leaf END AS f,
            row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM t)""",
        "a0 AS (SELECT tree, i, leaf AS d, n FROM x)",
        *tree("a", source_levels),
        f"b0 AS (SELECT 0 AS tree, tree AS i, d, (SELECT count(*) FROM a{source_levels}) AS n FROM a{source_levels})",
        *tree("b", top_levels),
        "w0 AS (SELECT row, tree, i, f, '' AS p FROM x)",
        *walk("a", "w", source_levels),
        f"v0 AS (SELECT row, 0 AS tree, tree AS i, f, p FROM w{source_levels})",
        *walk("b", "v", top_levels),
    ]
    return f"""WITH {", ".join(ctes)}
        SELECT x.doc_id, x.leaf, a.d AS subroot, b.d AS root, sha256(v.p) AS proof_sha256, v.f AS folded_root, v.f = b.d AS verified
        FROM x JOIN a{source_levels} a USING (tree) CROSS JOIN b{top_levels} b JOIN v{top_levels} v ON v.row = x.row"""


@_query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    u AS MATERIALIZED (SELECT r, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}),
    reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
    n AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
    SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
    """


@_query("op13_embedding_near_dedup", OP13_SQL)
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
