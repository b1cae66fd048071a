"""Session settings, lineage cutting and the few plan helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Every many-to-one join here keeps its many side on the left, so
# the skew reader may split a hot key (a third of all calls naming `len`, say) over many tasks.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What a Python worker holds at once: a thousand rows, or fewer of long texts. Rows are 10,000 by default, whatever their size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", app: str = "attestry"):
    """A local session for tests and the bench. On a cluster the caller brings its own and calls `tune`."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="attestry-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession) -> str:
    """Path of a table that is not there yet, in the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the checkpoint folder; half the cost of a checkpoint, and columns can be pruned."""
    path = new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin rows over the cluster before a costly per-row step, only where a scan has too few splits.

    A large table already has more splits than cores and passes through without a shuffle. For plain scans only:
    counting the splits of a plan with a shuffle in it would run that shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed rule table as a local relation."""
    return spark.createDataFrame(rows, schema)
