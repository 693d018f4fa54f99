"""Arrow batches through Python functions, for operators that built-ins can't express."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of a batch, which bound a Python worker's memory.
ROWS, BYTES = 500, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = spark.conf.get(key).strip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Bytes up to which an input counts as small.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input over all cores, since it may come as a single split.

    Larger inputs have splits enough, and their texts aren't shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    told = re.match(r"sizeInBytes=([0-9.E+]+) (B|KiB|MiB)\b", df._jdf.queryExecution().optimizedPlan().stats().simpleString())
    size = float(told[1]) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20}[told[2]] if told else float("inf")
    return df.repartition(cores) if cores > 1 and 0 < size <= SMALL else df


def with_column(df: DataFrame, source: str, name: str, ddl: str, build: Callable[[], Callable], batched: bool = False) -> DataFrame:
    """Add a column computed from one string column; nulls stay null.

    ``build()`` runs once a task, so that automata and tables are made once there.  Its
    function gets a text, or with ``batched`` the list of a batch's texts that aren't null.
    """
    bound_batches(df.sparkSession)
    df = spread(df)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {ddl}").fields])
    arrow = to_arrow_schema(schema)
    place = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = build()
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(place).to_pylist()
                done = iter(work([t for t in texts if t is not None]) if batched else map(work, (t for t in texts if t is not None)))
                values = [None if text is None else next(done) for text in texts]
                columns = [*batch.columns, pa.array(values, arrow.field(len(arrow) - 1).type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
