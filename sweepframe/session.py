"""Session settings and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows (a few numbers each) may be broadcast.
BROADCAST_ROWS = ("sweepframe.broadcastRows", 250_000)
#: A group of at most this many rows may be sorted inside one task.
GROUP_ROWS = ("sweepframe.groupRows", 1_000_000)

_local_dir: str | None = None


def limit(spark: SparkSession, setting: tuple[str, int]) -> int:
    name, default = setting
    return int(spark.conf.get(name, str(default)))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own,
    removed when Python exits.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", "")
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder shared by all executors"
        )
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="sweepframe-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path for one intermediate table.

    All tables of an application share one folder, so that folder can be removed
    when the application is over.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/sweepframe/{application}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it lies on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application.

    Nothing that was returned before can be read afterwards, unless it was written
    to a place of its own.
    """
    remove(spark, f"{shared_dir(spark)}/sweepframe/{spark.sparkContext.applicationId}")


@dataclass(frozen=True)
class Written:
    """A table on the shared folder together with its measured row count."""

    df: DataFrame
    rows: int
    path: str

    def drop(self) -> None:
        """Delete the table once nothing reads it any more."""
        remove(self.df.sparkSession, self.path)


def write_table(df: DataFrame, label: str) -> Written:
    """Write ``df`` once and read it back.

    Cuts the lineage, so a lost executor never recomputes what lies before,
    and the row count (observed during the write, no extra job) tells the
    caller whether the table may be broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return Written(spark.read.schema(df.schema).parquet(path), seen.get["rows"], path)


def fix_splits(spark: SparkSession) -> None:
    """Keep file splits the same for the whole session.

    Spark derives the split size from the number of cores it sees, which
    changes when executors come and go. Line positions are counted per split,
    so both scans of a text set must cut it alike.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
