"""Incremental ingest: new files of a folder become documents, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.sources import files


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, *, loaders=files.LOADERS, once: bool = True) -> StreamingQuery:
    """Writes documents of new files to the Parquet folder `out`/documents and failures to `out`/failures, each batch to a folder
    of its number: a batch that is played again replaces itself.

    Corpus-wide stages (relations, ranking, topics) stay batch work over what was gathered.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = stream.option("recursiveFileLookup", "true").load(folder)
    found = found.select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("path"), "content")

    def write(batch, number: int) -> None:
        raw = files.load(batch, loaders).persist()
        files.to_documents(raw).write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        raw.filter("status != 'loaded'").select("path", "status", "error").write.mode("overwrite").parquet(f"{out}/failures/batch={number}")
        raw.unpersist()

    writer = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
