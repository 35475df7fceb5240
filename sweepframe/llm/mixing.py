"""Mix sources to target weights.

Documents get hash-random keys and are range-sorted by source and key, so a large
source lies in many partitions. Running word counts inside the partitions plus the
totals of the partitions before give each document its place within its source,
and a budget cuts each source at an exact word. Budgets beyond a source's size take
whole epochs first.

Defined results: sources go by code point, NULL is a source of its own and the
last; a NULL text has size 0 and takes nothing; documents with equal keys go by id,
and equal rows share whatever their places get, in any order; empty tables give
empty results; other columns are ignored by :func:`assigned` and kept by
:func:`mixed`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.llm import batches
from sweepframe.session import write_table

SEED = 42
CAP = 3
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def source_key(source: Column) -> Column:
    """Sorts as the sources do: by code point, NULL last; never NULL itself."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def running(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same group
    that come earlier in ``order``. Runs a job; no group has to fit into a task.

    ``group`` must not be NULL. The sums inside each range partition are written
    together with the rows; what the partitions before hold is one row per group
    and partition.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in parts:
            if batch.num_rows == 0:
                continue
            groups = batch.column(group).dictionary_encode()
            code = groups.indices.to_numpy(zero_copy_only=False)
            values = batch.column(value).to_numpy(zero_copy_only=False)
            total = np.cumsum(values) - values
            heads = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
            reset = total[heads].copy()
            if groups.dictionary[int(code[0])].as_py() == last:
                reset[0] -= carried
            sizes = np.diff(np.append(heads, len(code)))
            before = total - np.repeat(reset, sizes)
            last, carried = groups.dictionary[int(code[-1])].as_py(), int(before[-1] + values[-1])
            yield batch.append_column("before", pa.array(before, pa.int64()))

    kinds = [f"`{c}` {kind}" for c, kind in ranged.dtypes]
    schema = ", ".join([*kinds, "part int", "before long"])
    local = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, schema)
    local = write_table(local, "running").df
    in_order = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        local.groupBy(group, "part")
        .agg(F.sum(value).alias("held"))
        .select(group, "part", F.coalesce(F.sum("held").over(in_order), F.lit(0)).alias("offset"))
    )
    return local.join(parts, [group, "part"]).select(
        *df.columns, (F.col("before") + F.col("offset")).alias("before")
    )


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, cap: int = CAP) -> DataFrame:
    """``sources`` (a row per ``source_key`` with its ``source_size``) with ``target``.

    Weights repeat in the order of the keys. A target stops at ``cap`` times its
    source's size and the excess is shared again among the others by weight. Each
    round is an aggregate over the sources that returns one row; the number of
    rounds is at most the number of sources and in practice a handful.
    """
    ranked = running(
        sources.withColumn("all", F.lit(0)).withColumn("one", F.lit(1)), "all", ["source_key"], "one"
    )
    weight = F.array(*map(F.lit, weights))[(F.col("before") % len(weights)).cast("int")]
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("most", cap * F.col("source_size"))
    ranked = write_table(ranked.select("source_key", "source_size", "weight", "most"), "sources").df
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:
        full = F.col("most") < level * F.col("weight")
        held, free = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        rest = float(total - held)
        if not free or rest / free <= level:
            break
        level = rest / free
    shared = F.lit(rest) * F.col("weight") / F.lit(float(free or 1))
    return ranked.withColumn("target", F.when(full, F.col("most").cast("double")).otherwise(shared))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per row: id, source, number of words, hash-random key, digest of the text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                count = batches.words(batches.as_text(part.column("text"))).counts
                kept = [part.column(c) for c in ("id", "source", "digest")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(count)], ["id", "source", "digest", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    found = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.md5(text).alias("digest"),
        text.alias("text"),
    ).mapInArrow(run, f"id {kind}, source string, digest string, size long")
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return found.withColumn("source_key", source_key(F.col("source"))).withColumn("key", key)


def assigned(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: its size, its source's size and target, and the words
    the mix takes of it, epochs counted. Runs jobs.

    The budget of a source is its target without the fraction of a word. Of the
    document at the cut only the first words are taken.
    """
    rows = write_table(sized(docs, id_col, text_col, source_col), "sized").df
    placed = running(rows, "source_key", ["key", "id", "digest"], "size")
    sources = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    placed = placed.join(targets(sources, weights), "source_key")
    size, whole = F.col("size"), F.col("source_size")
    budget = F.floor("target").cast("long")
    epochs = F.when(whole > 0, F.expr("CAST(floor(target) AS LONG) DIV source_size")).otherwise(0)
    rest = F.least(F.greatest(budget - epochs * whole - F.col("before"), F.lit(0)), size)
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "digest",
        "size",
        "source_size",
        "target",
        (epochs * size + rest).alias("taken"),
    )


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents the mix takes, a row per epoch, all columns kept. Runs jobs.

    The last copy of the document at a source's cut holds only the words taken.
    Rows are told apart by id and text: remove copies that share both before.
    """
    plan = assigned(docs, weights, id_col, text_col, source_col).where("taken > 0")
    plan = plan.select(
        F.col(id_col).alias("__id"), F.col("digest").alias("__digest"), F.col("size").alias("__size"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) DIV size"))).alias("__copy"),
        F.col("taken").alias("__taken"),
    )
    joined = docs.join(
        plan.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.md5(F.col(text_col)) == F.col("__digest"))
    )
    left = F.least(F.col("__taken") - F.col("__copy") * F.col("__size"), F.col("__size"))
    first_words = F.concat(F.lit(f"^(?:{SPACES}*+{WORD}++){{"), left.cast("string"), F.lit("}+"))
    cut = F.call_function("regexp_extract", F.col(text_col), first_words, F.lit(0))
    text = F.when(left < F.col("__size"), cut).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*docs.columns)
