"""Prepared tables and per-recording summaries on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.sources import commits

# Column names of the summary files and the names used here.
SUMMARY_NAMES = {
    "Vpulse": "v_pulse",
    "I.inst": "i_inst",
    "I.0": "i_inst",
    "I.50": "i_50",
    "I.100": "i_100",
    "I.150": "i_150",
    "I.200": "i_200",
    "I.400": "i_400",
    "I.ss": "i_ss",
    "I.600": "i_ss",
    "I.tailSS": "i_tail_ss",
    "I.tail": "i_tail",
    "I.tailSSfull": "i_tail_ss_full",
    "I.inst.pre": "i_inst_pre",
    "I.ss.pre": "i_ss_pre",
    "norm.tail": "norm_tail",
    "td.tail": "td_tail",
    "thresh.tail": "thresh_tail",
    "td.current": "td_current",
    "td.ratio": "td_ratio",
    "frac.tail": "frac_tail",
    "td.test": "td_test",
    "thresh.test": "thresh_test",
    "decay.pulse": "decay_pulse",
    "td.pre": "td_pre",
    "fold.pre": "fold_pre",
    "tapp50": "tapp50",
    "tapp50.pre": "tapp50_pre",
    "tapp50.test": "tapp50_test",
    "tapp50.tail": "tapp50_tail",
}
_TEXT = ("id", "channel", "Pip", "file", "recording", "cond")


#: Folder column of written tables; the key itself stays a column of the data, because
#: folder names lose its type.
FOLDER = "_folder"
#: Folders of a summary table.
BUCKETS = 64


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite"):
    """Write Parquet, one folder per value of ``by``, which must have few values.

    Rebalancing joins small pieces and splits big ones, so a value with few rows is
    one file and a huge one is several. Only folders present in ``df`` are replaced.
    """
    if by is None:
        df.write.mode(mode).parquet(path)
        return
    _write_folders(df.withColumn(FOLDER, F.col(by).cast("string")), path, FOLDER, mode)


def _write_folders(df: DataFrame, path: str, by: str, mode: str) -> None:
    (
        df.hint("rebalance", by)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A written table with all columns that it was ever written with.

    ``version``: an older version of a table of summaries.
    """
    if commits.is_table(spark, path.rstrip("/")):
        return commits.read(spark, path, version)
    return spark.read.option("mergeSchema", True).parquet(path).drop(FOLDER)


def write_summaries(
    df: DataFrame, path: str, by: str = "recording", csv: bool = False, buckets: int = BUCKETS,
    batch: tuple[str, int] | None = None,
):
    """Add summaries to a table; recordings that are in it already are replaced.

    Parquet has a fixed number of folders, so millions of recordings are not millions
    of files, and changes by whole commits (see ``commits``): readers see all of a write or
    nothing, columns are added and never lost, and ``batch`` makes a repeated write count
    once. Runs jobs.

    CSV has a folder per recording with header and no row names, for exchange.
    """
    if csv:
        (
            df.withColumn(FOLDER, F.col(by).cast("string"))
            .hint("rebalance", FOLDER)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("header", True)
            .partitionBy(FOLDER)
            .csv(path)
        )
        return
    commits.upsert(df, path, by, buckets, batch)


def read_summaries(
    spark: SparkSession, path: str | list[str], header: list[str], glob: str = "*.csv",
    text: Sequence[str] = (),
) -> DataFrame:
    """All summary files as one table with known types.

    Columns are numbers but for the metadata and those named in ``text``.

    ``header`` lists the columns of the files in order; an empty first name is
    the row-name column and is dropped. Dotted names become snake case.
    """
    kinds = []
    for k, name in enumerate(header):
        kind = "int" if name == "sweep" else "string" if name in (*_TEXT, *text) else "double"
        kinds.append(f"`{name or '_row'}` {'string' if k == 0 and not name else kind}")
    raw = (
        spark.read.option("header", True)
        .option("nullValue", "NA")
        .option("pathGlobFilter", glob)
        .option("enforceSchema", True)
        .schema(", ".join(kinds))
        .csv(path)
    )
    kept = [c for c in raw.columns if c not in ("_row", FOLDER)]
    return raw.select(*[raw[f"`{c}`"].alias(SUMMARY_NAMES.get(c, c)) for c in kept])
