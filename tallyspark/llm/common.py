"""Helpers that the operators share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose texts are Python objects at the same time.  Arrow batches themselves are bounded in bytes by Spark
#: (spark.sql.execution.arrow.maxBytesPerBatch).
TEXT_BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset and the master is local (tests on one machine) a temporary folder
    takes its place; on a cluster that is an error, as executors would not see it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if spark.sparkContext.applicationId not in _LOCAL:
            _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tallyspark-")
        found = _LOCAL[spark.sparkContext.applicationId]
    return found.rstrip("/")


#: Folders of local sessions without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df as a table in the shared folder, with these options, and read it again.

    This cuts the lineage: a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyspark/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    path = getattr(df, "_tallyspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> str:
    """Give back what finished jobs left on the driver; returns what the JVM says of its native memory.

    Spark deletes shuffles and broadcasts of frames that nothing refers to any more once the
    driver collects its garbage.  Besides its heap the JVM has native memory, of compilers and of
    a thread for each exchange and broadcast; the C library keeps what they freed until it is trimmed.
    """
    gc.collect()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:  # by reflection on the interface, as the class of the server is not open to callers
        named, lang = jvm.java.lang.Class.forName, jvm.java.lang
        kinds = array(lang.Class, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        given = array(lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)).strip()
    except Py4JError:  # a JVM without this command keeps that memory
        return ""


def small_batches(spark: SparkSession) -> None:
    """For applications, not operators: Arrow batches of this session hold few texts, so that workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most that many; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow where fn turns one batch of at most TEXT_BATCH_ROWS rows into the columns of schema, in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_filter(docs: DataFrame, good: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """docs, all its columns, with the rows whose texts good accepts; asked for TEXT_BATCH_ROWS texts at once."""
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("boolean")
    def ask(texts):
        return pd.Series([ok for at in range(0, len(texts), TEXT_BATCH_ROWS) for ok in good(texts.iloc[at : at + TEXT_BATCH_ROWS].tolist())], dtype=bool)

    return docs.where(ask(docs["text"]))


def crc_mod(column: str, mod: int):
    """crc32 of an id as text, modulo mod: the fold rule of the labelled tables."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod
