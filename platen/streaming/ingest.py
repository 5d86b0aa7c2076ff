"""New PDF files as they arrive: a stateless stream into Parquet relations.

A file is one input row, so nothing is kept between batches; the checkpoint
makes each file count once.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.options import ExtractOptions
from platen.sources.pdf.reader import ROW, extract, relation

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_rows(spark: SparkSession, path: str, options: ExtractOptions | None = None, files_per_batch: int = 1000, kinds: tuple[str, ...] | None = None) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch).load(path)
    return extract(files, options, kinds=kinds)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, options: ExtractOptions | None = None, kinds: tuple[str, ...] = ("pages", "chars"), available_now: bool = True):
    """Starts a query that appends each relation under target; a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind in kinds:
            relation(batch, kind).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/{kind}")
        batch.unpersist()

    writer = stream_rows(spark, source, options, kinds=kinds).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives of all that is there now, through a table and a checkpoint in the cluster's shared folder."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="platen-")
    at = f"{root.rstrip('/')}/platen/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


__all__ = ["drained", "FILES", "ROW", "ingest", "stream_rows"]
