"""Throughput of the trace pipelines on synthetic recordings of real size.

    python -m checks.trace_bench [recordings] [folder]

Writes the samples once as Parquet (and one recording as text) into a fresh
folder, then times summaries, smoothing and fits.
"""

from __future__ import annotations

import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.compare import local_session
from sweepframe import Protocol
from sweepframe.operators.annotate import cut
from sweepframe.operators.smooth import savgol
from sweepframe.plans import relax, steps
from sweepframe.sources.traces import read_traces

SWEEPS, PER_SWEEP = 24, 39_936
PROTOCOL = Protocol()


def samples(spark: SparkSession, recordings: int) -> DataFrame:
    """Step sweeps from +110 to -120 mV with bi-exponential relaxations and noise."""
    rows = spark.range(recordings * SWEEPS * PER_SWEEP, numPartitions=8 * 4)
    n = F.col("id")
    base = rows.select(
        F.format_string("c%05d ch 5K-Na f.txt", (n / (SWEEPS * PER_SWEEP)).cast("long")).alias(
            "recording"
        ),
        ((n / PER_SWEEP).cast("long") % SWEEPS + 1).cast("int").alias("sweep"),
        (n % PER_SWEEP).alias("sample_idx"),
        F.xxhash64("id").alias("h"),
    ).withColumn("t", F.col("sample_idx") * F.lit(PROTOCOL.dt))
    step = 120 - 10 * F.col("sweep")
    noise = (F.pmod("h", F.lit(2001)) - 1000) / 1e5
    test, post = F.col("t") - 0.6, F.col("t") - 1.3

    def relaxing(x, fast, slow):
        return 0.6 * F.exp(-F.lit(fast) * x) + 0.4 * F.exp(-F.lit(slow) * x)

    i = (
        F.when(F.col("t") < 0.6, 0.1)
        .when(F.col("t") < 1.3, (step + 130) / 100 * (1.2 - relaxing(test, 140.0, 7.0)))
        .otherwise((step + 130) / 100 * relaxing(post, 110.0, 8.0))
    )
    in_step = (F.col("t") >= 0.6) & (F.col("t") < 1.3)
    return base.select(
        "recording", F.substring_index("recording", " ", 1).alias("id"),
        F.lit("ch").alias("channel"), F.lit("5K-Na").alias("Pip"), F.lit("f.txt").alias("file"),
        "sweep", "sample_idx", "t", (i + noise).alias("i"),
        F.when(in_step, step.cast("double")).otherwise(-80.0).alias("v"),
    )


def timed(label: str, df: DataFrame, rows: int) -> None:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    print(f"{label:28s} {took:7.1f} s {rows / took / 1e6:7.2f} M rows/s", flush=True)


def main() -> None:
    recordings = int(sys.argv[1]) if len(sys.argv) > 1 else 10
    folder = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="run-")
    spark = local_session()
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    n = recordings * SWEEPS * PER_SWEEP
    samples(spark, recordings).write.parquet(f"{folder}/samples")
    stored = spark.read.parquet(f"{folder}/samples")
    timed("scan", stored, n)
    start = time.perf_counter()
    summary = steps.summarise(stored, PROTOCOL, invert=False)
    summary.write.parquet(f"{folder}/summary")
    took = time.perf_counter() - start
    print(f"{'summaries with half-times':28s} {took:7.1f} s {n / took / 1e6:7.2f} M rows/s")
    print(spark.read.parquet(f"{folder}/summary").select(
        F.count("tapp50"), F.count("tapp50_tail"), F.avg("tapp50")).first())
    part = cut(stored.select("recording", "sweep", "sample_idx", "t", "i"), PROTOCOL.test_phase())
    timed("smoothing of the test pulse", savgol(part), recordings * SWEEPS * 13_978)
    start = time.perf_counter()
    tails = relax.tail(stored, PROTOCOL)
    fits = relax.fit(tails)
    done = fits.fits.groupBy("status").count().collect()
    took = time.perf_counter() - start
    print(f"{'tail fits':28s} {took:7.1f} s {done}")
    one = spark.read.parquet(f"{folder}/samples").filter("recording = 'c00000 ch 5K-Na f.txt'")
    text = one.orderBy("sweep", "sample_idx").select(F.concat_ws("\t", "t", "i", "v"))
    text.coalesce(1).write.text(f"{folder}/text")
    timed("text lines of one recording",
          read_traces(spark, f"{folder}/text", PER_SWEEP), SWEEPS * PER_SWEEP)


if __name__ == "__main__":
    main()
