"""Exact duplicates by deterministic block naming.

Texts are compared after each run of spaces became one space. Documents whose
length and first characters no other document has are already told apart. The others are cut into
blocks of a fixed size; sorting the distinct blocks names them by integers, then
neighbouring names are paired and the distinct pairs sorted and named, until each
document has one name. Names come from whole contents, not from hashes, so equal
names mean equal texts.

Every naming is a grouping, in which partial sums make hot blocks small, and a sort of
what each task has left; a name is the task's number and the place in its order. Hot names
are only joined to, which adaptive joins split. Texts are joined by shuffles at every size,
because the keys of shared texts grow with the corpus.

Defined results: a NULL text is empty; of equal texts the smallest id stays, NULL
ids last; of rows that share the id as well one stays; empty tables give empty
results; other columns are ignored by :func:`groups` and kept by :func:`distinct`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.session import write_table

#: Characters of a block.
BLOCK = 4096
#: Characters at the start that tell most documents apart, together with the length.
HEAD = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of some columns, sorted, with an integer ``name`` each."""
    distinct = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("seen")).drop("seen")
    ordered = distinct.sortWithinPartitions(*columns)
    return write_table(ordered.withColumn("name", F.monotonically_increasing_id()), "names").df


def _identities(texts: DataFrame, block: int) -> DataFrame:
    """``row``, ``round``, ``name`` for ``texts`` (row, norm): equal (round, name)
    mean equal texts. Runs jobs, two for each halving of the longest text."""
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut)
    blocks = texts.select("row", cut.alias("blocks"))
    blocks = blocks.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("i", "block"))
    names = _named(blocks, ["block"])
    line = write_table(blocks.join(names.hint("merge"), "block").select("row", "n", "i", "name"), "line").df
    done, round_ = [], 0
    while True:
        done.append(line.where("n = 1").select("row", F.lit(round_).alias("round"), "name"))
        rest = line.where("n > 1")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        round_ += 1
        side = F.col("i") % 2
        pairs = rest.groupBy("row", F.floor(F.col("i") / 2).cast("int").alias("half")).agg(
            F.ceil(F.max("n") / 2).cast("int").alias("n"),
            F.max(F.when(side == 0, F.col("name"))).alias("a"),
            # the last of an odd number has no neighbour; names are never negative
            F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = write_table(pairs, "pairs").df
        names = _named(pairs, ["a", "b"])
        line = write_table(
            pairs.join(names, ["a", "b"]).select("row", "n", F.col("half").alias("i"), "name"), "line"
        ).df


def _shared(keys: DataFrame) -> DataFrame:
    counted = keys.groupBy("length", "head").agg(F.count(F.lit(1)).alias("rows"))
    return write_table(counted.where("rows > 1").select("length", "head"), "shared").df


def _with_keys(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` as ``doc`` with the normalised text, its length and first characters."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), normalised(F.col(text_col)).alias("norm"))
    return keyed.withColumns({"length": F.length("norm"), "head": F.substring("norm", 1, HEAD)})


def _grouped(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (row, id, norm and more) with ``keep_id``, ``group_size``, ``kept``."""
    ids = write_table(rows.drop("norm").join(_identities(rows.select("row", "norm"), block), "row"), "ids").df
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    found = ids.groupBy("round", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    # written, so that both sides are shuffled as they are and a hot name can be split
    found = write_table(found, "groups").df
    return (
        ids.join(found.hint("merge"), ["round", "name"])
        .withColumn("keep_id", F.col("first.id"))
        .withColumn("kept", F.col("row") == F.col("first.row"))
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: the id that stays, the size of its group, whether it is the row that
    stays, and the SHA-256 of the normalised text. Runs jobs."""
    keyed = _with_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    keyed = keyed.select(F.col("doc.id").alias("id"), "norm", "length", "head")
    hashed = keyed.withColumn("text_sha256", F.sha2("norm", 256))
    light = write_table(hashed.drop("norm"), "light").df
    shared = _shared(light).hint("merge")
    alone = light.join(shared, ["length", "head"], "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    rows = hashed.join(shared, ["length", "head"], "left_semi").select("id", "norm", "text_sha256")
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "candidates").df
    found = _grouped(rows, block).select("id", "keep_id", "group_size", "kept", "text_sha256")
    return alone.unionByName(found).withColumnRenamed("id", id_col)


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are. Runs jobs."""
    keyed = _with_keys(docs, text_col)
    shared = _shared(keyed).hint("merge")
    alone = keyed.join(shared, ["length", "head"], "left_anti").select("doc.*")
    rows = keyed.join(shared, ["length", "head"], "left_semi").select("doc", "norm")
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "candidates").df
    found = _grouped(rows.select("row", F.col(f"doc.{id_col}").alias("id"), "norm"), block)
    kept = rows.join(found.where("kept").select("row").hint("merge"), "row", "left_semi").select("doc.*")
    return alone.unionByName(kept)
