"""What the training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold, so that a Python worker's memory has a bound.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Bytes that one partition of a table between steps holds about.
PART_BYTES = 8 << 20
#: ASCII white space of the word contracts: space and \x09 to \x0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that executors hand to Python; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).strip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the session names.

    The shuffle files behind it, which nothing reads any more, are dropped once it is written.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session or its context.

    Where neither names one, a local master, whose tasks run in the driver, gets a folder of
    its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp()
    if not folder:
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return folder


def counted(df: DataFrame, row_bytes: int) -> tuple[DataFrame, int]:
    """``cut`` with the number of rows, counted as they are written.

    Rows of about row_bytes each come back in partitions of about PART_BYTES, if that needs
    no shuffle, so that a small table doesn't keep a task and shuffle files for each of the
    partitions it was made in.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = seen.get.get("rows", 0)
    context = df.sparkSession.sparkContext
    return out.coalesce(max(1, min(context.defaultParallelism, -(-rows // 1000)), -(-rows * row_bytes // PART_BYTES))), rows


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and nothing reads any more."""
    for table in tables:
        plan, jvm = table._jdf.queryExecution().analyzed(), table.sparkSession._jvm
        while plan.children().size():
            plan = plan.children().head()
        if (told := plan.rdd().getCheckpointFile()).isDefined():
            path = jvm.org.apache.hadoop.fs.Path(told.get())
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of fewer splits than cores is dealt over the cores (tables that are one small file)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_rows(df: DataFrame, columns: list[str], schema: str, step: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Run a batch function over some columns; ``step()`` is built once in each task.

    Only ``columns`` reach Python, so other columns, whatever their names, do no harm.
    The function gets lists by column name and returns lists by output name.
    """
    bounded_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = step()
        for batch in batches:
            if batch.num_rows:
                out = work({name: batch.column(name).to_pylist() for name in batch.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
