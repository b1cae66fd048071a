"""Explicit schemas. Nothing in the engine infers one: JSON inference would turn big integers into doubles."""

# A function corpus file is a JSON array of these. `body` is kept as its JSON text.
FUNCTION_JSON = (
    "name STRING, file STRING, params ARRAY<STRING>, vararg STRING, kwarg STRING, "
    "classBases MAP<STRING,STRING>, body STRING, _corrupt STRING"
)
NODES = (
    "module STRING, fn STRING, node_id INT, parent_id INT, depth INT, role STRING, pos INT, k STRING, op STRING, "
    "name STRING, recv STRING, label STRING, v STRING, v_type STRING, under_pruned BOOLEAN, under_set_index BOOLEAN, "
    "is_doc BOOLEAN, body_root BOOLEAN"
)
VAL = "kind STRING, v STRING"
CASES = (
    "case_id BIGINT, fn STRING, origin STRING, self STRING, args ARRAY<STRING>, "
    "outcome STRUCT<tag: STRING, value: STRING>"
)
ANSWERS = "case_id BIGINT, tag STRING, value STRING, label STRING"
DUALS = (
    "call_id BIGINT, fn STRING, args ARRAY<BIGINT>, native BIGINT, native2 BIGINT, other_status STRING, "
    "other_value BIGINT, mem_bytes BIGINT"
)
PROBLEMS = (
    "sample_id STRING, id STRING, spec STRING, `Spec.lean` STRING, impl STRING, `Impl.lean` STRING, pbt_code STRING, "
    "pbt_sample_name STRING, pbt_repo STRUCT<name: STRING, url: STRING>, is_canonical BOOLEAN, num_theorems INT, "
    "implementation_level STRING, actually_invokes_given BOOLEAN, _corrupt STRING"
)
THEOREMS = (
    "problem_id STRING, name STRING, statement STRING, binders ARRAY<STRUCT<names: STRING, type: STRING>>, "
    "hyps ARRAY<STRING>, unequal ARRAY<STRUCT<lhs: STRING, rhs: STRING>>, conclusion STRING, lhs STRING, rel STRING, "
    "rhs STRING, idents ARRAY<STRING>, subjects ARRAY<STRING>, stubs ARRAY<STRING>, spec_axioms ARRAY<STRING>, "
    "has_sorry BOOLEAN, sorries INT, analyzed BOOLEAN, reason STRING"
)
RECORDS = (
    "artifact STRING, artifact_sha256 STRING, parser_version STRING, exporter STRING, exporter_sha256 STRING, "
    "source_path STRING, source_revision STRING, command STRING, schema_version INT"
)
BASELINE = "artifact STRING, artifact_sha256 STRING, reason STRING"
MANIFEST = "module STRING, ast_sha256 STRING, ast_bytes BIGINT, ast_tracked BOOLEAN, render_sha256 STRING"
STAGES = "target STRING, stage STRING, ok BOOLEAN, seconds DOUBLE, timed_out BOOLEAN, peak_rss_mb DOUBLE"
