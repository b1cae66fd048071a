"""Readers and writers: function corpora, problem files, source trees, evidence, provenance, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry import schemas
from attestry.session import inline, spread
from attestry.sources import json_arrays

# Directories never part of a source tree, and the artifact kinds an assurance case looks for.
SKIPPED_DIRS = [".git", "__pycache__", ".lake", "node_modules", ".mypy_cache"]
EVIDENCE_FILES = {
    "ast": "ast-{module}.json", "graph": "formalization-graph.json", "conformance": "conformance.json",
    "mutation": "mutation.json", "ledger": "ledger-{module}.json", "axioms": "axioms.json",
    "contracts": "contracts-{module}.json", "coreOracle": "core-oracle.json", "audit": "audit.json",
}


def _base_name(path):
    return F.element_at(F.split(path, "/", -1), -1)


def read_functions(spark: SparkSession, glob: str) -> DataFrame:
    """All corpora of a glob as one table; `ast-<module>.json` names the module, `pos` is the index in the file's array.

    An array is read by as many tasks as it has splits (see `json_arrays`). A record that is no function, and what follows the
    last whole record of a broken file, is a row with `_corrupt` and no name.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = json_arrays.records(spark, glob).withColumn("r", F.from_json("record", schemas.FUNCTION_JSON, options))
    return rows.select(
        F.regexp_extract(_base_name(F.col("source_path")), r"^ast-(.*)\.json$", 1).alias("module"), "r.name", "r.file", "r.params", "r.vararg",
        "r.kwarg", "r.classBases", "r.body", "pos", F.when(F.col("whole"), F.col("r._corrupt")).otherwise(F.col("record")).alias("_corrupt"), "source_path",
    )


def corpus_errors(spark: SparkSession, glob: str) -> DataFrame:
    """Files that are not a JSON array of functions, or hold none: neither may pass for a corpus."""
    found = read_functions(spark, glob).groupBy(F.col("source_path").alias("path")).agg(
        F.count_if(F.col("name").isNotNull() & F.col("_corrupt").isNull()).alias("functions"),
        F.count_if(F.col("_corrupt").isNotNull()).alias("corrupt"),
    )
    joined = json_arrays.heads(spark, glob).withColumnRenamed("source_path", "path").join(found, "path", "left")
    error = (
        F.when(~F.col("is_array"), "not an array")
        .when(F.coalesce("corrupt", F.lit(0)) > 0, "unreadable")
        .when(F.coalesce("functions", F.lit(0)) == 0, "empty corpus")
    )
    return joined.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), error.alias("error")).where(F.col("error").isNotNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, split, line_no, value): lines of text files with their number in the file, from 1, whatever tasks read them.

    Lines are counted per split and the counts added up along each file; then a line's number is that of its split's first line
    and its place in the split.
    """
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value"
    )
    splits = scan.groupBy("source_path", "split").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    along = Window.partitionBy("source_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source_path", "split", "first", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("seq") - F.col("first") + 1
    return spread(scan).join(splits, ["source_path", "split"]).select("source_path", "split", number.alias("line_no"), "value")


def first_rows(df: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of `df` in the order of source_path, split and line_no; only the split in which they end is sorted."""
    counts = df.groupBy("source_path", "split").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("source_path", "split").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < limit)
    near = df.join(counts, ["source_path", "split"])
    whole = near.filter(F.col("_before") + F.col("_n") <= limit)
    place = F.row_number().over(Window.partitionBy("source_path", "split").orderBy("line_no"))
    part = near.filter(F.col("_before") + F.col("_n") > limit).withColumn("_place", place).filter(F.col("_before") + F.col("_place") <= limit).drop("_place")
    return whole.unionByName(part).drop("_n", "_before")


def read_problems(spark: SparkSession, path: str, limit: int | None = None, canonical_only: bool = False) -> DataFrame:
    """Benchmark rows with a specification; a row without an id is named by its line. The limit takes the first that the canonical filter left."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    blank = lambda *cols: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    problems = (
        lines.select("source_path", "split", "line_no", F.from_json("value", schemas.PROBLEMS, options).alias("r"))
        .select("source_path", "split", "line_no", "r.*")
        .where(F.col("_corrupt").isNull())
        .select(
            "source_path", "split", "line_no",
            F.coalesce("sample_id", "id", F.concat(F.lit("line"), "line_no")).alias("problem_id"),
            F.coalesce("pbt_repo.name", F.lit("?")).alias("repo"), F.coalesce("pbt_repo.url", F.lit("")).alias("repo_url"),
            blank("spec", "`Spec.lean`").alias("spec"), blank("impl", "`Impl.lean`").alias("impl"),
            F.coalesce("pbt_sample_name", F.lit("")).alias("pbt_name"),
            F.coalesce("is_canonical", F.lit(False)).alias("is_canonical"),
            F.coalesce("num_theorems", F.lit(0)).alias("declared_theorems"), "implementation_level",
            F.col("actually_invokes_given").alias("claims_invokes_impl"),
        )
        .where(F.col("spec") != "")
    )
    if canonical_only:
        problems = problems.where("is_canonical")
    return (problems if limit is None else first_rows(problems, limit)).drop("split")


def bad_problem_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that were skipped, with their numbers, so that skipping is reported."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull()).select("source_path", "line_no", F.col("value").alias("line"))


def read_source_tree(spark: SparkSession, root: str, exts: list[str]) -> DataFrame:
    """Files under a root with text and the number of newline bytes; version-control and cache folders are skipped."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in exts) + "}")
        .load(root)
    )
    skipped = "|".join(d.replace(".", "[.]") for d in SKIPPED_DIRS)
    text = F.decode("content", "UTF-8")
    return spread(files.where(~F.col("path").rlike(f"/({skipped})/"))).select(
        "path", text.alias("text"), (F.octet_length("content") - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"),
        "length", "content",
    )


def read_evidence(spark: SparkSession, root: str, modules: list[str]) -> DataFrame:
    """One row per (module, kind): an unreadable artifact is the same as a missing one."""
    expected = inline(
        spark, [(m, k, f.format(module=m)) for m in modules for k, f in EVIDENCE_FILES.items()],
        "module STRING, kind STRING, file STRING",
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(root).select(
        _base_name(F.col("path")).alias("file"), F.decode("content", "UTF-8").alias("payload"), "path"
    )
    readable = files.where(F.try_parse_json("payload").isNotNull())
    tag = F.get_json_object("payload", "$.module")
    return expected.join(readable, "file", "left").select(
        "module", "kind", F.col("payload").isNotNull().alias("present"), tag.alias("subject_module"), "path", "payload"
    )


def read_provenance(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Sidecar records and the baseline of artifacts known to be unattributed."""
    raw = "artifact STRING, artifact_sha256 STRING, joern_version STRING, exporter STRING, exporter_sha256 STRING, " \
          "source_path STRING, source_revision STRING, command STRING, schema_version INT, _corrupt STRING"
    records = (
        spark.read.schema(raw).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.prov.json").json(f"{root}/provenance")
    )
    named = records.select(
        F.regexp_extract(_base_name(F.col("_metadata.file_path")), r"^(.*)\.prov\.json$", 1).alias("artifact"),
        "artifact_sha256", F.col("joern_version").alias("parser_version"), "exporter", "exporter_sha256", "source_path",
        "source_revision", "command", "schema_version", F.col("_corrupt").isNotNull().alias("unreadable"),
        F.col("artifact").alias("recorded_artifact"),
    )
    entry = "STRUCT<artifact_sha256: STRING, reason: STRING>"
    baseline = (
        spark.read.schema(f"artifacts MAP<STRING, {entry}>").option("multiLine", True)
        .option("pathGlobFilter", "unattributed.json").json(f"{root}/provenance")
        .select(F.explode("artifacts").alias("artifact", "e"))
        .select("artifact", "e.artifact_sha256", "e.reason")
    )
    return named, baseline


def write_report(df: DataFrame, path: str, order: list[str], slim: bool = True, theorems: str = "theorems") -> None:
    """A report of JSON rows in the order of `order`, ties in that of the JSON text, committed as a whole.

    Rows are range-partitioned; each part is a folder `part=N` of the report's own data folder, and its lines carry their place.
    The manifest, one row for each part with its number of rows and the sum of their hashes, is written last: until then readers
    see the report before, and a lost task or job leaves no half report. slim keeps only the theorems someone has to look at.
    """
    if slim and theorems in df.columns:
        df = df.withColumn(theorems, F.filter(theorems, lambda t: t["status"].isin("flagged", "not_analyzed")))
    folder = f"rows-{uuid.uuid4().hex}"
    keys = [f"_key{i}" for i in range(len(order))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(order, keys)], F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias("row"))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "row")
    at = F.monotonically_increasing_id()
    placed = dealt.select(F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(2**33 - 1).alias("place"), "row")
    placed.write.partitionBy("part").parquet(f"{path}/{folder}")
    _parts(df.sparkSession, f"{path}/{folder}").withColumn("folder", F.lit(folder)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


REPORT_ROWS = "place BIGINT, row STRING, part INT"


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(REPORT_ROWS).parquet(folder)
    digest = F.sum(F.xxhash64("place", "row").cast("decimal(38,0)")).cast("string")
    return rows.groupBy("part").agg(F.count("*").alias("rows"), digest.alias("digest"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a report with `part` and `place`, by which they are in order. A report that isn't what its manifest says is an error."""
    manifest = spark.read.schema("part INT, rows BIGINT, digest STRING, folder STRING").json(f"{path}/manifest")
    named = manifest.select("folder").limit(1).collect()
    if not named:
        return spark.createDataFrame([], schema).withColumns({"part": F.lit(0), "place": F.lit(0).cast("bigint")})
    folder = f"{path}/{named[0].folder}"
    found = _parts(spark, folder)
    if not manifest.drop("folder").exceptAll(found).unionAll(found.exceptAll(manifest.drop("folder"))).isEmpty():
        raise ValueError(f"the report in {path} isn't what its manifest says")
    rows = spark.read.schema(REPORT_ROWS).parquet(folder)
    return rows.select(F.from_json("row", schema).alias("r"), "part", "place").select("r.*", "part", "place")
