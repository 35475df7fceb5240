"""Which ids each set has, kept as bitmaps and merged by batches.

A folder holds two tables that change by whole commits:

* ``ids``: every id with a number. Ids are dealt to parts by a hash and numbered from 1
  inside their part, so that new ones need no look at the other parts;
* ``maps``: per set, part and 32,768 numbers one bitmap of 4 KB.

A batch of (set, id) rows adds the ids that are new, makes bitmaps of its own and joins them
with those of the same place. Only parts with new ids and bitmaps that change are written.
Joining bits twice changes nothing, so a batch that died half-way, or came before, may be
tried again. One writer at a time.

Counts of distinct ids are sums of bits; ids that several sets share are found 32,768 at a time.
Rows without an id are left out. A set is named by one or more columns, whose NULLs count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.operators.keyed import matched, positions
from sweepframe.session import write_table
from sweepframe.sources import commits

PARTS = 64
MAP = "_map"
PLACE = ["_part", "_span"]


def _ids(folder: str) -> str:
    return f"{folder.rstrip('/')}/ids"


def _maps(folder: str) -> str:
    return f"{folder.rstrip('/')}/maps"


def _numbered(members: DataFrame, path: str, parts: int) -> DataFrame:
    """Numbers of the ids in ``members`` (_part, id); new ids are committed first."""
    spark = members.sparkSession
    wanted = members.select("_part", "id").distinct()
    if commits.current(spark, path).number:
        old = commits.read_keys(members.select("_part"), path, "_part").select("_part", "id", "_number")
    else:
        old = spark.createDataFrame([], "_part int, id string, _number long")
    fresh = write_table(matched(wanted, old.select("_part", "id"), ["_part", "id"], "left_anti"), "new-ids")
    if not fresh.rows:
        return old
    tops = old.groupBy("_part").agg(F.max("_number").alias("_top"))
    placed = matched(positions(fresh.df, ["_part"], ["id"], "_at"), tops, ["_part"])
    number = F.col("_at") + 1 + F.coalesce("_top", F.lit(0).cast("long"))
    new = write_table(placed.select("_part", "id", number.alias("_number")), "numbers").df
    # a part is replaced as a whole
    beside = matched(old, fresh.df.select("_part").distinct(), ["_part"], "left_semi")
    commits.upsert(beside.unionByName(new), path, "_part", parts)
    return old.unionByName(new)


def update(
    rows: DataFrame, folder: str, by: Sequence[str], id_column: str = "id", parts: int = PARTS
) -> None:
    """Add the ids of a batch to the sets named by ``by``. Runs jobs.

    ``parts`` counts for a new folder.
    """
    spark, by, path = rows.sparkSession, list(by), _maps(folder)
    parts = commits.current(spark, _ids(folder)).buckets or parts
    name = F.col(id_column).cast("string")
    part = F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    seen = rows.where(name.isNotNull()).select(*by, part.alias("_part"), name.alias("id"))
    members = write_table(seen.distinct(), "members").df
    numbers = _numbered(members, _ids(folder), parts)
    known = matched(members, numbers, ["_part", "id"], "inner")
    bits = known.groupBy(*by, "_part", F.bitmap_bucket_number("_number").alias("_span")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("bits")
    )
    place = F.to_json(F.struct(*by, *PLACE), {"ignoreNullFields": "false"})
    new = write_table(bits.withColumn(MAP, place).withColumn("_old", F.lit(False)), "bitmaps").df
    both = new
    if commits.current(spark, path).number:
        old = commits.read_keys(new.select(MAP), path, MAP)
        both = new.unionByName(old.select(*bits.columns, MAP, F.lit(True).alias("_old")))
    merged = both.groupBy(*by, *PLACE, MAP).agg(
        F.bitmap_or_agg("bits").alias("bits"), F.max(F.when(F.col("_old"), F.col("bits"))).alias("_was")
    )
    changed = merged.where("not bits <=> _was").drop("_was")
    commits.upsert(changed, path, MAP, parts)


def distinct_counts(spark: SparkSession, folder: str, by: Sequence[str]) -> DataFrame:
    """Number of distinct ids per set; with fewer columns than the sets have, of their union."""
    maps = commits.read(spark, _maps(folder))
    joined = maps.groupBy(*by, *PLACE).agg(F.bitmap_or_agg("bits").alias("bits"))
    return joined.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def common_counts(
    spark: SparkSession, folder: str, by: Sequence[str], name: str, sets: Sequence[object]
) -> DataFrame:
    """Number of ids per group that each of the ``sets``, levels of column ``name``, has.

    Groups in which a set has no id are left out.
    """
    maps = commits.read(spark, _maps(folder)).where(F.col(name).isin(list(sets)))
    shared = maps.groupBy(*by, *PLACE).agg(
        F.bitmap_and_agg("bits").alias("bits"), F.collect_set(name).alias("_sets")
    )
    whole = F.when(F.size("_sets") == len(set(sets)), F.bitmap_count("bits")).otherwise(0)
    found = shared.groupBy(*by).agg(F.sum(whole).alias("n"), F.flatten(F.collect_set("_sets")).alias("_sets"))
    return found.where(F.size(F.array_distinct("_sets")) == len(set(sets))).drop("_sets")


def _has(bits: Column, number: Column) -> Column:
    """Whether the bit of a number is set in its bitmap."""
    at = F.bitmap_bit_position(number)
    byte = F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1


def _placed_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = commits.read(spark, _ids(folder))
    return ids.withColumn("_span", F.bitmap_bucket_number("_number"))


def members(spark: SparkSession, folder: str, by: Sequence[str]) -> DataFrame:
    """The sets with their ids, a row each."""
    maps = commits.read(spark, _maps(folder)).select(*by, *PLACE, "bits")
    joined = _placed_ids(spark, folder).join(maps, PLACE)
    return joined.where(_has(F.col("bits"), F.col("_number"))).select(*by, "id").distinct()


def coverage(spark: SparkSession, folder: str, name: str, sets: Sequence[str]) -> DataFrame:
    """Which of the ``sets``, levels of column ``name``, have each id: TRUE, or NULL.

    An id that none of them has gets no row.
    """
    maps = commits.read(spark, _maps(folder)).where(F.col(name).isin(list(sets)))
    one = maps.groupBy(name, *PLACE).agg(F.bitmap_or_agg("bits").alias("bits"))
    # one row per set and place, so the largest is the only one
    wide = one.groupBy(*PLACE).agg(*[F.max(F.when(F.col(name) == s, F.col("bits"))).alias(s) for s in sets])
    flags = [F.when(_has(F.col(s), F.col("_number")), True).alias(s) for s in sets]
    rows = _placed_ids(spark, folder).join(wide, PLACE).select("id", *flags)
    return rows.where(F.coalesce(*[F.col(s) for s in sets]))
