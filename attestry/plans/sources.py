"""Sources and sinks: files that Spark writes from the given tables into the checkpoint folder and reads back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.plans.registry import query, table
from attestry.session import new_table
from attestry.sources import corpora

CHUNK = 1000  # documents of a file, by doc_id


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The JSON texts of a partition as lines of one array."""
    line = lambda *text: pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["value"])
    yield line("[")
    comma = ""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        if texts:
            yield line(*[(comma if i == 0 else ",") + t for i, t in enumerate(texts)])
            comma = ","
    yield line("]")


@query(
    "a_functions",
    """SELECT 'd' || doc_id AS name, source AS file, CAST(2 AS BIGINT) AS n_params, sha256(text) AS vararg_sha256,
      sha256('{"k":"str","v":"' || doc_id || '}"}') AS body_sha256, CAST(1 AS BIGINT) AS places FROM documents""",
)
def functions(spark, sf):
    """Arrays of one function a document, its text as a string of it; each place in an array is held by one function."""
    docs = table(spark, sf, "documents")
    body = F.struct(F.lit("str").alias("k"), F.concat(F.col("doc_id").cast("string"), F.lit("}")).alias("v"))
    made = docs.select(F.to_json(F.struct(
        F.concat(F.lit("d"), "doc_id").alias("name"), F.col("source").alias("file"), F.array(F.lit('"]'), F.col("lang")).alias("params"), F.col("text").alias("vararg"), body.alias("body"),
    )).alias("value"))
    path = new_table(spark)
    made.mapInArrow(_as_array, "value string").write.text(path)
    found = corpora.read_functions(spark, path)
    places = found.groupBy("source_path", "pos").agg(F.count("*").alias("places"))
    return found.join(places, ["source_path", "pos"]).select("name", "file", F.size("params").cast("bigint").alias("n_params"), F.sha2("vararg", 256).alias("vararg_sha256"), F.sha2("body", 256).alias("body_sha256"), "places")


def _chunks(spark, sf, value):
    """One text file for each CHUNK of documents, a line (or more, where texts have line feeds) for each document by doc_id."""
    path = new_table(spark)
    docs = table(spark, sf, "documents").withColumn("chunk", F.floor(F.col("doc_id") / CHUNK))
    docs.repartition("chunk").sortWithinPartitions("chunk", "doc_id").select("chunk", value.alias("value")).write.partitionBy("chunk").text(path)
    return path


@query(
    "a_problems",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id // {CHUNK} ORDER BY doc_id) AS line_no FROM documents)
    SELECT CASE WHEN doc_id % 3 = 0 THEN 'line' || line_no ELSE 's' || doc_id END AS problem_id, sha256(text) AS spec_sha256, doc_id % 2 = 0 AS is_canonical, line_no
    FROM l WHERE doc_id % 7 <> 0 AND text <> ''""",
)
def problems(spark, sf):
    """Lines of problems, some without an id, and some that are no JSON."""
    row = F.struct(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("s"), "doc_id")).alias("sample_id"), F.col("text").alias("spec"), (F.col("doc_id") % 2 == 0).alias("is_canonical"))
    path = _chunks(spark, sf, F.when(F.col("doc_id") % 7 == 0, F.lit("{oops")).otherwise(F.to_json(row)))
    found = corpora.read_problems(spark, f"{path}/*")
    return found.select("problem_id", F.sha2("spec", 256).alias("spec_sha256"), "is_canonical", "line_no")


@query(
    "a_bad_problem_lines",
    f"""SELECT line_no, count(*) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // {CHUNK} ORDER BY doc_id) AS line_no FROM documents)
    WHERE doc_id % 7 = 0 GROUP BY line_no""",
)
def bad_problem_lines(spark, sf):
    path = _chunks(spark, sf, F.when(F.col("doc_id") % 7 == 0, F.lit("{oops")).otherwise(F.lit("{}")))
    return corpora.bad_problem_lines(spark, f"{path}/*").groupBy("line_no").agg(F.count("*").alias("n"))


@query(
    "a_source_tree",
    f"""SELECT doc_id // {CHUNK} AS chunk, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
    FROM documents GROUP BY 1""",
)
def source_tree(spark, sf):
    files = corpora.read_source_tree(spark, _chunks(spark, sf, F.col("text")), [".txt"])
    return files.select(F.regexp_extract("path", r"chunk=(\d+)", 1).cast("bigint").alias("chunk"), F.col("lines").cast("bigint").alias("lines"), F.col("length").alias("bytes"))


@query("a_report", "SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY source, n_chars, doc_id) - 1 AS at FROM documents")
def report(spark, sf):
    """A report in the order of source, length and doc_id, read back with the place of each row in the whole."""
    path = new_table(spark)
    corpora.write_report(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), path, ["source", "n_chars", "doc_id"])
    rows = corpora.read_report(spark, path, "doc_id BIGINT, source STRING, n_chars BIGINT")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return rows.join(before, "part", "left").select("doc_id", "source", "n_chars", (F.coalesce("before", F.lit(0)) + F.col("place")).alias("at"))
