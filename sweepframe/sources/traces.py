"""Text exports of recordings: headerless ``t<TAB>I<TAB>V`` lines, sweeps in a row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sweepframe.functions.scalars import before_dot, tokens
from sweepframe.operators.annotate import number_sweeps
from sweepframe.session import BROADCAST_ROWS, fix_splits, limit, write_table

META = ("id", "channel", "Pip", "file")


def decoded(path: Column) -> Column:
    """File names arrive URL-encoded; a literal plus sign stays a plus sign."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def meta_columns(
    name: Column, meta: Sequence[str] = META, sep: str = "[ ]"
) -> dict[str, Column]:
    """Metadata named by ``meta`` from the pieces of a file name."""
    pieces = tokens(name, sep)
    return {m: F.get(pieces, F.lit(k)) for k, m in enumerate(meta)}


def add_condition(df: DataFrame, file: str = "file") -> DataFrame:
    """Condition label: the file token up to its first dot."""
    return df.withColumn("cond", before_dot(file))


def list_files(
    spark: SparkSession, path: str | list[str], glob: str = "*.txt",
    recursive: bool = False,
) -> DataFrame:
    """Files by name pattern, optionally in all subfolders, without reading them."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(path)
        .select(
            decoded(F.col("_metadata.file_path")).alias("path"),
            decoded(F.col("_metadata.file_name")).alias("file_name"),
            F.col("_metadata.file_size").alias("bytes"),
        )
    )
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return found.withColumn("folder", folder)


def check_filenames(
    files: DataFrame, meta: Sequence[str] = META, sep: str = "[ ]"
) -> DataFrame:
    """Token table of all files; ``ok`` tells whether the name has the right parts."""
    pieces = tokens("file_name", sep)
    return files.select(
        "file_name",
        *[c.alias(m) for m, c in meta_columns(F.col("file_name"), meta, sep).items()],
        F.size(pieces).alias("n_tokens"),
        (F.size(pieces) == len(meta)).alias("ok"),
    )


def text_lines(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Trimmed lines of a text column with their zero-based position."""
    return df.select(
        *keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line")
    ).withColumn("line", F.trim("line"))


def parse_sample(line: Column) -> list[Column]:
    """Time, current and voltage of one line; unreadable numbers become NULL."""
    parts = F.split(line, "\t")
    return [
        F.trim(F.get(parts, F.lit(k))).try_cast("double").alias(name)
        for k, name in enumerate(("t", "i", "v"))
    ]


def _folders(path: str | list[str], glob: str) -> int:
    """Number of folders named by the paths of folders and files."""
    paths = [path] if isinstance(path, str) else path
    parts = [p.rstrip("/").rpartition("/") for p in paths]
    return len({a if fnmatch(name, glob) else f"{a}/{name}" for a, _, name in parts})


def read_traces(
    spark: SparkSession,
    path: str | list[str],
    n_per_sweep: int,
    sep: str = "[ ]",
    meta: Sequence[str] = META,
    glob: str = "*.txt",
    recursive: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Samples of all matching files with metadata, sweep and sample number.

    Line order is the data, yet files of any size are read in parallel: a line's
    position is its number in the file split, counted as the split is read, plus the
    lines of the splits before it. Lines are not shuffled unless files have several
    splits (or ``strict`` is off) and the splits are too many to broadcast. Blank lines
    do not count.

    A recording whose length is not a multiple of ``n_per_sweep`` stops the job
    when ``strict``; otherwise its last rows have ``complete = false``.

    A recording is named by its file, and by its whole path when more than one folder
    is read. Runs a job that counts the lines, and fixes the session's file splits.
    """
    fix_splits(spark)
    lines = _lines(spark, path, glob, recursive)
    # one row per file split; a file has as many as its bytes / split size
    in_file, of_name = W.partitionBy("_path"), W.partitionBy("_name")
    ordered = in_file.orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        lines.groupBy("_path", "_name", "_start")
        .agg(F.count(F.lit(1)).alias("_lines"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_lines").over(ordered), F.lit(0)),
                "n_samples": F.sum("_lines").over(in_file),
                "_shared": F.min("_path").over(of_name) != F.max("_path").over(of_name),
            }
        )
    )
    splits = write_table(splits, "splits").df
    by_path = recursive or _folders(path, glob) > 1
    _stop_on(splits, _faults(n_per_sweep, strict, by_path))

    numbered = _numbered(lines)
    changed = F.raise_error(
        F.concat(F.lit("file splits changed between scans: "), F.col("_path"))
    ).cast("long")
    local = F.col("_local")
    if strict and splits.filter("_start > 0").isEmpty():
        # every file is one split, in which its lines are numbered already
        placed = numbered.withColumn("n_samples", F.lit(None).cast("long"))
        pos = F.when(F.col("_start") == 0, local).otherwise(changed)
    else:
        placed = _with_splits(numbered, splits.drop("_name", "_shared"))
        pos = F.when(
            local.between(0, F.col("_lines") - 1), local + F.col("_before")
        ).otherwise(changed)
    recording = decoded(F.col("_path" if by_path else "_name"))
    name = decoded(F.col("_name"))
    samples = placed.select(
        recording.alias("recording"),
        *[c.alias(m) for m, c in meta_columns(name, meta, sep).items()],
        pos.alias("pos"),
        "n_samples",
        *parse_sample(F.col("line")),
    )
    swept = number_sweeps(samples, n_per_sweep, "pos", None if strict else "n_samples")
    if strict:
        # anything else has stopped the job
        swept = swept.withColumn("complete", F.lit(True))
    return swept.drop("pos", "n_samples")


def _with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with the columns of their splits, if these are known; broadcast up to the limit.

    A split has as many lines as fit into its bytes, so beyond the limit a plain shuffle
    is even, and is given a number of tasks that small inputs do not reduce.
    """
    keys = ["_path", "_start"]
    if splits.count() <= limit(rows.sparkSession, BROADCAST_ROWS):
        return rows.join(F.broadcast(splits), keys, "left")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).join(splits.repartition(n, *keys).hint("merge"), keys, "left")


def _lines(spark: SparkSession, path: str | list[str], glob: str, recursive: bool) -> DataFrame:
    """Lines that are not blank, with their file and the place where their split begins."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .text(path)
        .select(
            F.trim("value").alias("line"),
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_name").alias("_name"),
            F.col("_metadata.file_block_start").alias("_start"),
        )
        .filter(F.col("line") != "")
    )


def _faults(n_per_sweep: int, strict: bool, by_path: bool) -> Column:
    """What is wrong with a file, by a row of its splits."""
    faults = F.when(
        F.lit(strict) & (F.col("n_samples") % n_per_sweep != 0),
        F.concat(F.lit("incomplete last sweep: "), F.col("_path")),
    )
    if by_path:
        return faults
    # a pattern in the path may reach into several folders
    text = F.lit("files of several folders share the name ")
    return F.when(F.col("_shared"), F.concat(text, F.col("_name"))).otherwise(faults)


def land_traces(
    spark: SparkSession,
    path: str | list[str],
    out: str,
    n_per_sweep: int,
    glob: str = "*.txt",
    recursive: bool = False,
    strict: bool = True,
) -> None:
    """Write the samples of all matching files as a table, reading the text once.

    A sample keeps the number that it got as its task read it. These numbers run on
    within a file split, so that a row for each split, counted from the written table
    without another look at the text, is enough to tell a sample's place in its file:
    ``read_landed`` adds the difference. Neither Python nor a shuffle is in the way of a
    sample, and the splits need not stay the same afterwards. Faults stop as in
    ``read_traces``, before anything can be read. Runs jobs.
    """
    out = out.rstrip("/")
    lines = _lines(spark, path, glob, recursive)
    # the number is given after blank lines are gone
    numbered = lines.withColumn("_mark", F.monotonically_increasing_id())
    numbered.select("_path", "_name", "_start", "_mark", *parse_sample(F.col("line"))).write.parquet(f"{out}/samples")
    landed = spark.read.parquet(f"{out}/samples")
    in_file, of_name = W.partitionBy("_path"), W.partitionBy("_name")
    ordered = in_file.orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        landed.groupBy("_path", "_name", "_start")
        .agg(F.count(F.lit(1)).alias("_lines"), F.min("_mark").alias("_first"), F.max("_mark").alias("_last"))
        .withColumns(
            {
                "_shift": F.coalesce(F.sum("_lines").over(ordered), F.lit(0)) - F.col("_first"),
                "n_samples": F.sum("_lines").over(in_file),
                "_shared": F.min("_path").over(of_name) != F.max("_path").over(of_name),
            }
        )
    )
    splits = write_table(splits, "splits").df
    by_path = recursive or _folders(path, glob) > 1
    torn = F.col("_last") - F.col("_first") + 1 != F.col("_lines")
    text = F.concat(F.lit("lines of a split are not in a row: "), F.col("_path"))
    _stop_on(splits, F.when(torn, text).otherwise(_faults(n_per_sweep, strict, by_path)))
    kept = splits.select("_path", "_start", "_shift", "n_samples", F.lit(by_path).alias("_by_path"))
    kept.write.parquet(f"{out}/splits")


def read_landed(
    spark: SparkSession, out: str, n_per_sweep: int, sep: str = "[ ]", meta: Sequence[str] = META
) -> DataFrame:
    """Samples of a folder of ``land_traces``, as ``read_traces`` gives them; those of an
    incomplete last sweep have ``complete = false``."""
    out = out.rstrip("/")
    splits = spark.read.parquet(f"{out}/splits")
    samples = _with_splits(spark.read.parquet(f"{out}/samples"), splits)
    recording = decoded(F.when(F.col("_by_path"), F.col("_path")).otherwise(F.col("_name")))
    named = samples.select(
        recording.alias("recording"),
        *[c.alias(m) for m, c in meta_columns(decoded(F.col("_name")), meta, sep).items()],
        (F.col("_mark") + F.col("_shift")).alias("pos"),
        "n_samples", "t", "i", "v",
    )
    return number_sweeps(named, n_per_sweep, "pos", "n_samples").drop("pos", "n_samples")


def _stop_on(splits: DataFrame, fault: Column) -> None:
    """Stop with the first fault, if there is one."""
    found = splits.select(fault.alias("fault")).filter("fault IS NOT NULL").limit(1)
    found.select(F.raise_error(F.col("fault"))).collect()


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_local``, their number within the file split.

    A task reads its splits one after the other, so counting needs no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            path = batch.column("_path").dictionary_encode()
            code = path.indices.to_numpy(zero_copy_only=False)
            start = batch.column("_start").to_numpy(zero_copy_only=False)
            new = np.ones(batch.num_rows, bool)
            new[1:] = (np.diff(code) != 0) | (np.diff(start) != 0)
            heads = np.flatnonzero(new)
            place = np.arange(batch.num_rows)
            local = place - np.repeat(heads, np.diff(np.append(heads, len(place))))
            if (path.dictionary[int(code[0])].as_py(), int(start[0])) == last:
                local[: heads[1] if len(heads) > 1 else None] += carried
            last = (path.dictionary[int(code[-1])].as_py(), int(start[-1]))
            carried = int(local[-1]) + 1
            yield batch.append_column("_local", pa.array(local, pa.int64()))

    schema = ", ".join(f"{c} {kind}" for c, kind in lines.dtypes)
    return lines.mapInArrow(count, f"{schema}, _local long")
