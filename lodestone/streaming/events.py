"""Windowed and stateful streams over the event table, and incremental maintenance.

Every stream runs over the files that are there (``availableNow``), with its
checkpoint and its sink in the shared folder, and the result is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream; the schema is taken from its files.

    All files come in one trigger, so that a watermark finds nothing late however
    the rows are spread over files.  ``files`` limits the files of a trigger, for
    streams without a watermark.
    """
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", place.getName()).parquet(str(place.getParent()))


def run(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run to the end of what is there; exactly-once files in append mode.

    ``base`` is the folder of checkpoint and output: a stream that failed resumes where
    it was if it is run again with the same one, and a finished one reads new files
    only.  Without it every run has its own."""
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/lodestone/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest row per key, kept up by micro-batches: every batch is reduced to its
    latest rows and written; reading reduces the batches' rows again.  A batch that
    is repeated after a failure writes to its own folder again, so nothing counts twice."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/lodestone/latest-{uuid.uuid4().hex}"

    def latest(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1")  # so that an empty stream has a result
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(f"{base}/out").drop("batch"))
