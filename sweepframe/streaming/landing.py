"""Summarise recordings as they arrive, combine them later.

The stream carries file names only. Each micro-batch reads its new files as an
ordinary batch job and commits the summaries of just those recordings as a whole. The
commit carries the number of the batch, so a batch that is tried again after its
commit changes nothing; summaries may get columns from one batch to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.session import write_table
from sweepframe.sources.tables import write_summaries
from sweepframe.sources.traces import decoded, read_traces


def summarise_new_files(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    summarise: Callable[[DataFrame], DataFrame],
    n_per_sweep: int,
    glob: str = "*.txt",
    files_per_batch: int = 1000,
    **read_options,
):
    """Process everything not seen yet, then stop. Returns the finished query."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    names = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(decoded(F.col("_metadata.file_path")).alias("path"))
    )

    def run(batch: DataFrame, number: int) -> None:
        # at most ``files_per_batch`` names
        paths = [r.path for r in batch.select("path").collect()]
        if paths:
            samples = read_traces(
                batch.sparkSession, paths, n_per_sweep, glob=glob, **read_options
            )
            # a summary reads its samples more than once: parse the text once
            landed = write_table(samples, "samples")
            write_summaries(summarise(landed.df), out, batch=(checkpoint, number))
            landed.drop()

    query = (
        names.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
