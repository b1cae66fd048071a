"""What the operators share: input columns, tables written between jobs, batch sizes, caches of a Python worker."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import tune

# Bytes of text that travel to a Python worker at once; a single row may be larger.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: bounded Arrow batches, adaptive joins that split hot keys, and shuffles that are
    removed when the query that made them ends, not when the driver next collects garbage. A frame that is run again shuffles again."""
    tune(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_text: str | None = "") -> DataFrame:
    """(doc_id, text) and no other column, so that no extra column can clash. A null text becomes `null_text`."""
    text = docs[text_col].cast("string")
    text = text if null_text is None else F.coalesce(text, F.lit(null_text))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))


def whole_row(docs: DataFrame, *without: str) -> Column:
    """All columns of `docs` but those named as one struct `row`, whatever their names hold, so that none can clash."""
    return F.struct(*[docs["`" + c.replace("`", "``") + "`"].alias(c) for c in docs.columns if c not in without]).alias("row")


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once and not again for each element of a transform in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        import tempfile

        named = tempfile.mkdtemp(prefix="attestry-shared-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def written(df: DataFrame) -> DataFrame:
    """The same rows, read again from a Parquet table in the shared folder: no lost executor makes Spark run the plan anew."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/attestry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dictionary that lives in the Python worker until it works for another operator; task functions travel by value, so module globals don't.

    Workers outlive stages and jobs. What one operator has kept is freed when the next one asks for its own.
    """
    home = sys.modules.setdefault("_attestry_worker_cache", types.ModuleType("_attestry_worker_cache"))
    for other in [k for k, v in vars(home).items() if isinstance(v, dict) and k != name and not k.startswith("__")]:
        del vars(home)[other]
    return vars(home).setdefault(name, {})


def pylist_batches(batches: Iterable, *columns: str) -> Iterator[tuple]:
    """Of each Arrow batch, the named columns as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
