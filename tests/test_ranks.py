"""Order statistics by counting, against sorted lists."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.operators import cohort, ranks

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf]


def doubles(rng, n):
    some = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(n)]
    powers = [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)]
    near = [f(p, to) for p in powers for f, to in ((math.nextafter, 0.0), (math.nextafter, math.inf))]
    some += powers + near + [-x for x in near] + ODD
    return [x for x in some if not math.isnan(x)]


def test_bits_keep_the_order_of_doubles(spark):
    xs = doubles(random.Random(1), 2000)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.x: r.k for r in df.select("x", ranks.ordered_bits(F.col("x")).alias("k")).collect()}
    for x, k in got.items():
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert k == (-bits if x < 0 else bits)
    nan = spark.createDataFrame([(math.nan,)], "x double").select(ranks.ordered_bits(F.col("x"))).first()[0]
    assert nan > max(got.values())


@pytest.mark.parametrize("tight", [False, True])
def test_quantiles_of_any_numbers(spark, request, tight):
    if tight:
        request.getfixturevalue("tight_limits")
    rng = random.Random(2)
    groups = {
        "bits": [x for x in doubles(rng, 500) if abs(x) < 1e300],
        "ties": [rng.choice([1.5, 2.5, -3.0]) for _ in range(400)],
        "near": [1.0 + rng.randrange(1 << 20) * 2.0**-52 for _ in range(700)],
        "one": [7.25],
        None: [rng.gauss(0, 1) for _ in range(33)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None]] + [("empty", None)]
    rng.shuffle(rows)
    probs = {"low": 0.0, "q": 0.25, "m": 0.5, "p": 0.9, "top": 1.0}
    out, _ = cohort.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", probs)
    got = {r.g: r for r in out.collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-14, abs=1e-300), (g, name)


@pytest.mark.parametrize("kind", ["long", "int", "float", "decimal(9,2)"])
def test_other_kinds_of_numbers(spark, kind):
    big = 1 << 60 if kind == "long" else 0
    xs = [big + k * k - 300 for k in range(41)]
    df = spark.createDataFrame([("a", x) for x in xs], "g string, x long").withColumn("x", F.col("x").cast(kind))
    _, rows = cohort.quantiles(df, ["g"], "x", {"m": 0.5})
    keyed = rows.withColumn("_bits", ranks.order_key(rows, "x"))
    found = ranks.at_ranks(keyed, ["g"], "x", lambda n: F.array(F.lit(20).cast("long"))).collect()
    assert [(r.n, r._ranks, int(r.x)) for r in found] == [(41, [20], xs[20])]
    with pytest.raises(ValueError, match="number"):
        ranks.order_key(df.withColumn("x", F.lit("a")), "x")


def test_values_are_not_sorted_and_counts_are_few(spark, monkeypatch):
    """Whatever is written: no range partitioning; after the values, only prefixes with a wanted rank."""
    plans, sizes = [], []

    def spy(df, label, f=ranks.write_table):
        plans.append(df._jdf.queryExecution().toString())
        out = f(df, label)
        sizes.append((label, out.rows))
        return out

    monkeypatch.setattr(ranks, "write_table", spy)
    monkeypatch.setattr(cohort, "write_table", spy)
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.sin(F.col("id").cast("double")).alias("x"))
    r = cohort.quantiles(df, ["g"], "x", {"m": 0.5})[0].first()
    assert r.m == pytest.approx(np.median(np.sin(np.arange(200_000.0))), abs=1e-15)
    assert not any("rangepartitioning" in p for p in plans)
    assert sizes[0] == ("values", 200_000) and max(n for _, n in sizes[1:]) <= 2
    assert len(sizes) <= 1 + 2 * 64 // ranks.ROUND_BITS
