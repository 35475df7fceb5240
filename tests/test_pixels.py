"""Plot tables of bounded size."""

import numpy as np
import pandas as pd

from sweepframe.operators.reshape import pixels


def test_extremes_and_crossings_survive(spark):
    rng = np.random.default_rng(2)
    n, columns = 5000, 40
    parts = []
    for sweep in (1, 2):
        y = np.cumsum(rng.normal(size=n))
        y[1234] = 500.0 * sweep
        y[4000:4010] = np.nan
        parts.append(pd.DataFrame({"sweep": sweep, "t": np.arange(n) / 1000, "i": y}))
    df = spark.createDataFrame(pd.concat(parts)).selectExpr("sweep", "t", "nullif(i, double('nan')) i").repartition(7)
    out = pixels(df, ["sweep"], "t", "i", 0.5, 4.5, columns)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = out.toPandas()
    assert got.groupby(["sweep", "pixel"]).size().max() <= 4 and len(got) <= 2 * 4 * columns
    for sweep, part in enumerate(parts, 1):
        shown = part[(part.t >= 0.5) & (part.t <= 4.5) & part.i.notna()]
        mine = got[got.sweep == sweep]
        pixel = np.minimum(np.floor((shown.t - 0.5) / 4.0 * columns).astype(int), columns - 1)
        for k, rows in shown.groupby(pixel):
            few = mine[mine.pixel == k].sort_values("t")
            assert few.i.min() == rows.i.min() and few.i.max() == rows.i.max()
            assert few.i.iloc[0] == rows.i.iloc[0] and few.i.iloc[-1] == rows.i.iloc[-1]
        assert mine.i.max() == 500.0 * sweep


def test_few_samples(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("b", 0.5, None), ("c", 7.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, i double")
    got = sorted(tuple(r) for r in pixels(df, ["k"], "t", "i", 0.0, 1.0, 1).collect())
    assert got == [("a", 0, "first", 0.0, 1.0), ("a", 0, "last", 1.0, 2.0)]
    assert pixels(df.limit(0), ["k"], "t", "i", 0.0, 1.0).collect() == []
