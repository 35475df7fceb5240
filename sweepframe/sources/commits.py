"""A Parquet table that changes by whole commits.

Rows lie in a fixed number of buckets by a hash of their key. A commit writes the buckets
it touches to a folder of its own and then one small file, the manifest: which folder has
each bucket's rows now, and all columns there have been. Data files are never changed.

* Readers take the newest complete manifest and see that commit as a whole.
* A write that dies leaves files that no manifest names; the version before stays.
* Columns are added, never lost: a row written before has NULL in them. Numbers may get
  wider; another type is refused before anything is written.
* A manifest is created under the next number and never replaced. A writer that finds the
  number taken starts from the newer version; buckets that did not change there need not
  be written again.
* A writer may name itself and number its batches: a batch that was committed before is
  left out, however often it is tried.

    table/
      data/<commit>/_bucket=<k>/part-...parquet
      versions/<number>.json
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepframe.operators.keyed import matched
from sweepframe.session import remove
from sweepframe.session import write_table as landed

BUCKET = "_bucket"
#: Numbers may become those to their right.
WIDER = ("byte", "short", "integer", "long", "double")
WIDENS = {("float", "double")} | {(a, b) for i, a in enumerate(WIDER) for b in WIDER[i + 1 :]} - {("long", "double")}


class Taken(Exception):
    """Another writer committed under this number."""


@dataclass(frozen=True)
class Version:
    """What a manifest says."""

    number: int = 0
    buckets: int = 0
    schema: T.StructType = field(default_factory=T.StructType)
    #: Bucket -> commit whose folder has its rows.
    folders: dict[int, str] = field(default_factory=dict)
    #: Writer -> last batch.
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(
            {
                "buckets": self.buckets,
                "schema": self.schema.jsonValue(),
                "folders": {str(k): v for k, v in sorted(self.folders.items())},
                "batches": self.batches,
            }
        )

    @staticmethod
    def parse(number: int, text: str) -> Version:
        found = json.loads(text)
        return Version(
            number,
            found["buckets"],
            T.StructType.fromJson(found["schema"]),
            {int(k): v for k, v in found["folders"].items()},
            found["batches"],
        )


# -- files ----------------------------------------------------------------------------


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    store, place = _store(spark, path)
    if not store.exists(place):
        return []
    return [s.getPath().getName() for s in store.listStatus(place)]


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers that are taken, newest first."""
    names = (re.fullmatch(r"(\d+)\.json", n) for n in _names(spark, f"{path}/versions"))
    return sorted((int(m[1]) for m in names if m), reverse=True)


def _load(spark: SparkSession, path: str, number: int) -> Version | None:
    """A version, or None if its writer died while it wrote the manifest."""
    store, place = _store(spark, f"{path}/versions/{number:012d}.json")
    stream = store.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return Version.parse(number, text)
    except ValueError:
        return None


def _create(spark: SparkSession, path: str, version: Version) -> None:
    store, place = _store(spark, f"{path}/versions/{version.number:012d}.json")
    try:
        stream = store.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            raise Taken(str(place)) from e
        raise
    stream.write(bytearray(version.text().encode()))
    stream.close()


def is_table(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def current(spark: SparkSession, path: str) -> Version:
    """The newest complete version; number 0 if there is none."""
    for number in _numbers(spark, path):
        if (found := _load(spark, path, number)) is not None:
            return found
    return Version()


# -- columns --------------------------------------------------------------------------


def _wider(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    for one, other in ((a, b), (b, a)):
        if (one.typeName(), other.typeName()) in WIDENS:
            return other
    raise ValueError(f"column {name} was {a.simpleString()} and cannot become {b.simpleString()}")


def all_columns(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, those of ``old`` first."""
    kinds = {f.name: f.dataType for f in old}
    for f in new:
        kinds[f.name] = _wider(f.name, kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


# -- reading and writing --------------------------------------------------------------


def _read(spark: SparkSession, path: str, version: Version, buckets: Sequence[int]) -> DataFrame:
    folders = [f"{path}/data/{version.folders[k]}/{BUCKET}={k}" for k in sorted(buckets)]
    if not folders:
        return spark.createDataFrame([], version.schema)
    return spark.read.schema(version.schema).parquet(*folders)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its newest version, or of an older one that is still kept."""
    path = path.rstrip("/")
    found = current(spark, path) if version is None else _load(spark, path, version)
    if found is None or not found.number:
        raise ValueError(f"no such version of {path}")
    return _read(spark, path, found, list(found.folders))


def _place(by: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(buckets)).cast("int")


def read_keys(keys: DataFrame, path: str, by: str) -> DataFrame:
    """Rows of the table whose ``by`` is one of ``keys``; only their buckets are read.

    Runs a job over the keys. The table must have a version.
    """
    spark, path = keys.sparkSession, path.rstrip("/")
    found = current(spark, path)
    # at most as many numbers as there are buckets
    some = {r[0] for r in keys.select(_place(by, found.buckets).alias("k")).distinct().collect()}
    rows = _read(spark, path, found, [k for k in found.folders if k in some])
    kind = found.schema[by].dataType
    return matched(rows, keys.select(F.col(by).cast(kind).alias(by)).distinct(), [by], "left_semi")


def upsert(
    df: DataFrame, path: str, by: str, buckets: int, batch: tuple[str, int] | None = None, tries: int = 10
) -> Version:
    """Commit rows; rows of the table with the same ``by`` go. Runs jobs.

    Only the buckets of the new rows are written again. ``buckets`` counts for a new table.
    ``batch``: name of the writer and number of the batch, which must grow.
    """
    if BUCKET in df.columns:
        raise ValueError(f"{BUCKET} is the table's own column")
    spark, path = df.sparkSession, path.rstrip("/")
    base = current(spark, path)
    if batch and base.batches.get(batch[0], -1) >= batch[1]:
        return base
    schema = all_columns(base.schema, df.schema)
    buckets = base.buckets or buckets
    # the rows may be dear to compute and are used three times
    new = landed(df.withColumn(BUCKET, _place(by, buckets)), "new-rows")
    # at most ``buckets`` numbers
    touched = sorted(r[0] for r in new.df.select(BUCKET).distinct().collect())
    keys = new.df.select(by).distinct()
    commit, seen = None, None
    for _ in range(tries):
        schema = all_columns(base.schema, df.schema)
        changed = {k: base.folders.get(k) for k in touched}
        if touched and (commit is None or changed != seen):
            rows = _shaped(new.df, schema)
            if old := [k for k in touched if k in base.folders]:
                kept = _shaped(_read(spark, path, base, old), schema)
                replaced = keys.select(F.col(by).cast(schema[by].dataType).alias(by))
                rows = rows.unionByName(matched(kept, replaced, [by], "left_anti"))
            commit, seen = uuid.uuid4().hex, changed
            (
                rows.withColumn(BUCKET, _place(by, buckets))
                .hint("rebalance", BUCKET)
                .write.partitionBy(BUCKET)
                .parquet(f"{path}/data/{commit}")
            )
        version = Version(
            max([base.number, *_numbers(spark, path)[:1]]) + 1,
            buckets,
            schema,
            base.folders | {k: commit for k in touched},
            base.batches | (dict([batch]) if batch else {}),
        )
        try:
            if current(spark, path).number != base.number:
                raise Taken(path)
            _create(spark, path, version)
        except Taken:
            base = current(spark, path)
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                break
            if base.buckets and base.buckets != buckets:
                raise ValueError(f"{path} was begun with another number of buckets meanwhile") from None
            continue
        new.drop()
        return version
    else:
        raise RuntimeError(f"other writers kept changing {path}")
    new.drop()
    return base


def forget(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the newest ``keep`` versions and the data that only they have; the
    names of the deleted commits. To be called while nothing writes or reads old versions."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path)
    complete = [n for n in numbers if _load(spark, path, n) is not None][: max(1, keep)]
    live = {c for n in complete for c in _load(spark, path, n).folders.values()}
    # manifests first: none may name data that is gone
    for n in numbers:
        if n not in complete:
            remove(spark, f"{path}/versions/{n:012d}.json")
    gone = [c for c in _names(spark, f"{path}/data") if c not in live]
    for c in gone:
        remove(spark, f"{path}/data/{c}")
    return gone

