"""Provenance, digests, freshness and the data contract of a corpus. Nothing to check is a finding, not a pass."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import names
from attestry.session import inline
from attestry.sources.corpora import SKIPPED_DIRS


def digest(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, sha256."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


# ------------------------------------------------------------------ tree digests


def _tree_batches(batches):
    """Streams sorted lines into one running hash per root, holding one batch at a time."""
    root, running, count = None, None, 0

    def finished():
        return pa.RecordBatch.from_pydict(
            {"root": [root], "digest": [f"tree-sha256:{running.hexdigest()}:{count}files"], "files": [count]},
            schema=pa.schema([("root", pa.string()), ("digest", pa.string()), ("files", pa.int64())]),
        )

    for batch in batches:
        for r, line in zip(*(c.to_pylist() for c in batch.columns)):
            if r != root:
                if running is not None:
                    yield finished()
                root, running, count = r, hashlib.sha256(), 0
            running.update(line.encode())
            count += 1
    if running is not None:
        yield finished()


def tree_digest(files: DataFrame) -> DataFrame:
    """files(root, rel, sha256) -> one digest per tree over `rel NUL sha LF` lines in path order.

    The digest is one running hash, so a tree is read in sequence; the sort spills and only its short lines stream by.
    """
    parts = F.split("rel", "/", -1)
    skipped = F.array(*[F.lit(d) for d in SKIPPED_DIRS])
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), skipped)
    line = F.concat(F.col("rel"), F.lit("\0"), F.col("sha256"), F.lit("\n"))
    return (
        files.where(~inside)
        .select("root", parts.alias("parts"), line.alias("line"))
        .repartition("root")
        .sortWithinPartitions("root", "parts")
        .select("root", "line")
        .mapInArrow(_tree_batches, "root STRING, digest STRING, files BIGINT")
    )


# ------------------------------------------------------------------ provenance


REQUIRED = [
    "schema_version", "recorded_artifact", "artifact_sha256", "parser_version", "exporter", "exporter_sha256", "source_path",
    "source_revision", "command",
]


def audit_provenance(
    artifacts: DataFrame, records: DataFrame, baseline: DataFrame, exporters: DataFrame, pin: str, sources: DataFrame | None = None
) -> DataFrame:
    """Every artifact with its state and findings; records of no artifact are orphans.

    artifacts(artifact, sha256), records as read, baseline(artifact, artifact_sha256, reason), exporters(exporter,
    sha256), sources(source_path, revision) to re-derive revisions. A record with missing fields is not checked further.
    """
    recorded = records.select(
        "artifact", F.lit(True).alias("recorded"), F.coalesce("unreadable", F.lit(False)).alias("unreadable"),
        F.struct(*REQUIRED).alias("r"),
    )
    waived = baseline.select("artifact", F.col("artifact_sha256").alias("waived_sha"), "reason", F.lit(True).alias("waived"))
    made_by = exporters.select(F.col("exporter").alias("_exporter"), F.col("sha256").alias("exporter_now"))
    joined = (
        artifacts.select("artifact", "sha256", F.lit(True).alias("exists"))
        .join(recorded, "artifact", "full_outer")
        .join(waived, "artifact", "left")
        .join(made_by, F.col("r.exporter") == F.col("_exporter"), "left")
    )
    if sources is None:
        joined = joined.withColumn("revision_now", F.lit(None).cast("string")).withColumn("source_seen", F.lit(False))
    else:
        now = sources.select(F.col("source_path").alias("_path"), F.col("revision").alias("revision_now"), F.lit(True).alias("source_seen"))
        joined = joined.join(now, F.col("r.source_path") == F.col("_path"), "left")
    blank = lambda f: F.col(f"r.{f}").isNull() | F.col(f"r.{f}").cast("string").isin("", "0")
    missing = F.array_compact(F.array(*[F.when(blank(f), F.lit(f)) for f in REQUIRED]))
    has, exists, waived = F.coalesce("recorded", F.lit(False)), F.coalesce("exists", F.lit(False)), F.coalesce("waived", F.lit(False))
    readable = exists & has & ~F.coalesce("unreadable", F.lit(False))
    complete = readable & (F.size(missing) == 0)
    sha = F.col("sha256")
    findings = [
        F.when(exists & ~has & ~waived, "coverage"),
        F.when(exists & ~has & waived & ~F.col("waived_sha").eqNullSafe(sha), "baseline-expired"),
        F.when(exists & has & ~readable, "unreadable"),
        F.when(readable & (F.size(missing) > 0), "fields"),
        F.when(complete & (F.col("r.artifact_sha256") != sha), "integrity"),
        F.when(complete & (F.col("r.parser_version") != pin), "pin"),
        F.when(complete & F.col("exporter_now").isNull(), "exporter-missing"),
        F.when(complete & (F.col("exporter_now") != F.col("r.exporter_sha256")), "exporter-drift"),
        F.when(complete & F.col("source_seen") & (F.col("revision_now") != F.col("r.source_revision")), "source-moved"),
        F.when(~exists & has, "orphan"),
    ]
    state = (
        F.when(complete, "attributed")
        .when(exists & ~has & waived & F.col("waived_sha").eqNullSafe(sha), "baselined")
        .otherwise("violation")
    )
    return joined.select(
        "artifact", state.alias("state"), F.array_compact(F.array(*findings)).alias("findings"), missing.alias("missing"), "reason"
    )


def provenance_summary(audited: DataFrame, strict: bool = False) -> DataFrame:
    """Totals and the outcome: nothing checked is its own outcome, and strict mode does not accept the baseline."""
    counts = audited.agg(
        F.count_if(~F.array_contains("findings", "orphan")).alias("artifacts"),
        F.count_if(F.col("state") == "attributed").alias("attributed"),
        F.count_if(F.col("state") == "baselined").alias("baselined"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("violations"),
    )
    outcome = (
        F.when(F.col("artifacts") == 0, "NOTHING_CHECKED")
        .when((F.col("violations") > 0) | (F.lit(strict) & (F.col("baselined") > 0)), "FAIL")
        .when(F.col("baselined") > 0, "PASS_WITH_GAP")
        .otherwise("PASS")
    )
    return counts.withColumn("outcome", outcome)


# ------------------------------------------------------------------ corpora against each other and against pins


def diff_corpora(a: DataFrame, b: DataFrame) -> DataFrame:
    """Functions only in one of two corpora, or in both with other bodies: (module, name, change).

    Bodies are compared as counted digests, so a name with many copies stays a few rows.
    """
    digests = lambda df, c: df.groupBy("module", "name", F.sha2("body", 256).alias("h")).agg(F.count("*").alias(c))
    paired = digests(a, "na").join(digests(b, "nb"), ["module", "name", "h"], "full_outer")
    change = (
        F.when(F.count("nb") == 0, "only_first").when(F.count("na") == 0, "only_second")
        .when(F.count_if(~F.col("na").eqNullSafe(F.col("nb"))) > 0, "body_differs").otherwise("same")
    )
    return paired.groupBy("module", "name").agg(change.alias("change"))


def diff_summary(changes: DataFrame) -> DataFrame:
    is_change = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changes.groupBy("module").agg(*[is_change(c) for c in ("only_first", "only_second", "body_differs", "same")])


def spec_freshness(specs: DataFrame, corpora: DataFrame) -> DataFrame:
    """specs(spec, corpus, pinned), corpora(corpus, sha256, recorded): a corpus gone from disk falls back on its record."""
    current = F.coalesce("sha256", "recorded")
    status = (
        F.when(current.isNull(), "unchecked").when(F.col("pinned").isNull(), "unpinned")
        .when(F.col("pinned") != current, "stale").otherwise("ok")
    )
    return specs.join(corpora, "corpus", "left").select("spec", "corpus", "pinned", current.alias("current"), status.alias("status"))


def manifest_verdict(manifest: DataFrame, asts: DataFrame, renders: DataFrame, live: DataFrame) -> DataFrame:
    """manifest(module, ast_sha256, render_sha256) against digests (module, sha256) of AST, fresh render and live copy."""
    take = lambda df, c: df.select("module", F.col("sha256").alias(c))
    joined = manifest.join(take(asts, "ast_now"), "module", "left").join(take(renders, "render_now"), "module", "left").join(
        take(live, "live_now"), "module", "left"
    )
    verdict = (
        F.when(F.col("ast_now").isNull(), F.struct(F.lit("UNVERIFIABLE"), F.lit("AST not found")))
        .when(F.col("ast_sha256").isNull(), F.struct(F.lit("UNVERIFIABLE"), F.lit("no digest recorded")))
        .when(F.col("ast_now") != F.col("ast_sha256"), F.struct(F.lit("MISMATCH"), F.lit("AST changed")))
        .when(F.col("render_now").isNull(), F.struct(F.lit("UNVERIFIABLE"), F.lit("no render")))
        .when(F.col("render_now") != F.col("render_sha256"), F.struct(F.lit("MISMATCH"), F.lit("render changed")))
        .when(F.col("live_now") != F.col("render_now"), F.struct(F.lit("MISMATCH"), F.lit("live copy is not the render")))
        .otherwise(F.struct(F.lit("OK"), F.lit("")))
        .cast("struct<verdict: string, detail: string>")
    )
    return joined.select("module", verdict.alias("v")).select("module", "v.verdict", "v.detail")


def exit_class(verdicts: DataFrame) -> DataFrame:
    """0 all verified, 1 a mismatch, 2 nothing could be checked, 3 some could not."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.agg(
        F.when(n("MISMATCH") > 0, 1).when(n("OK") == 0, 2).when(n("UNVERIFIABLE") > 0, 3).otherwise(0).alias("exit_class")
    )


def cross_check(metrics: DataFrame, required: DataFrame) -> DataFrame:
    """required(fact, artifact): all artifacts said to hold a fact must hold it, and hold the same value."""
    joined = required.join(metrics.select("fact", "artifact", "value"), ["fact", "artifact"], "left")
    finding = (
        F.when(F.count_if(F.col("value").isNull()) > 0, "absent")
        .when(F.min("value") != F.max("value"), "disagree").otherwise("ok")
    )
    return joined.groupBy("fact").agg(
        F.count("*").alias("artifacts"), F.min("value").alias("low"), F.max("value").alias("high"), finding.alias("finding")
    )


# ------------------------------------------------------------------ data contract

LABEL_SHAPE = r"^[A-Za-z][\w.-]*(:[\w.<>+-]+)+$"
# The import labels a corpus may carry, older ones included.
CONTRACT_IMPORT_LABELS = [
    "import:module-value", "import:unresolved", "import:absent:relative", "import:absent:prefix-in-cpg",
    "import:absent:external", "import:member-not-found", "import:operand",
]
EXACT_LIMIT = 2**53
UNQUOTED_SHARE = 0.02


def validate_contract(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per module and rule: rows checked and violations. A rule that checked no row has failed, whatever it counted."""
    k, v, vt, label = F.col("k"), F.col("v"), F.col("v_type"), F.col("label")
    number = v.try_cast("decimal(38,0)")
    hole, is_int = k.isin(rules.HOLE_KINDS), k == "int"
    ext = names.extension(F.coalesce("file", F.lit("")))
    function_rules = {
        "required_fields": (
            F.lit(True),
            F.coalesce(F.col("name"), F.lit("")).isin("") | F.col("file").isNull() | F.col("params").isNull()
            | F.exists(F.coalesce("params", F.array()), lambda p: p.isNull()) | ~F.coalesce(F.col("body").startswith("{"), F.lit(False)),
        ),
        "known_extension": (ext != "", ~ext.isin(list(rules.RENDER_DIALECTS))),
    }
    node_rules = {
        "int_exact": (is_int, ~vt.isin("int", "str") | ((vt == "int") & (F.abs(number) > EXACT_LIMIT)) | ((vt == "str") & ~v.rlike(r"^-?\d+$"))),
        "int_canonical": (is_int & (vt == "str"), F.abs(number) <= EXACT_LIMIT),
        "bool_literal": (k == "bool", vt != "bool"),
        "str_literal": (k == "str", vt != "str"),
        "hole_label": (hole, F.trim(F.coalesce(label, F.lit(""))) == ""),
        "label_namespaced": (hole, ~F.coalesce(label.rlike(LABEL_SHAPE), F.lit(False))),
        "import_vocabulary": (label.startswith("import:"), ~label.isin(CONTRACT_IMPORT_LABELS)),
        "known_kind": (k.isNotNull(), ~k.isin(rules.EXPR_KINDS + rules.STMT_KINDS)),
        "unquoted_literals": (F.lit(True), hole & (label == "lit:unquoted")),
    }

    def counted(df, table):
        aggregates = []
        for name, (applies, bad) in table.items():
            aggregates.append(F.count_if(F.coalesce(applies, F.lit(False))).alias(f"{name}_n"))
            aggregates.append(F.count_if(F.coalesce(applies & F.coalesce(bad, F.lit(True)), F.lit(False))).alias(f"{name}_bad"))
        entries = F.array(*[F.struct(F.lit(x).alias("rule"), F.col(f"{x}_n").alias("checked"), F.col(f"{x}_bad").alias("violations")) for x in table])
        return df.groupBy("module").agg(*aggregates).select("module", F.explode(entries).alias("e")).select("module", "e.*")

    optional = ["int_canonical", "import_vocabulary", "bool_literal", "str_literal", "known_extension"]
    share = F.col("violations") / F.nullif("checked", F.lit(0))
    failed = (
        F.when(F.col("checked") == 0, ~F.col("rule").isin(optional))
        .when(F.col("rule") == "unquoted_literals", share >= UNQUOTED_SHARE)
        .otherwise(F.col("violations") > 0)
    )
    both = counted(functions, function_rules).unionByName(counted(nodes, node_rules))
    return both.withColumn("failed", failed)


def nothing_checked(spark: SparkSession, contract: DataFrame) -> DataFrame:
    """One failing row when there was no corpus at all."""
    row = inline(spark, [("", "corpus_present", 0, 0, True)], "module STRING, rule STRING, checked BIGINT, violations BIGINT, failed BOOLEAN")
    return contract.unionByName(row) if contract.isEmpty() else contract
