"""Source mixing against a plain implementation."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from sweepframe.llm import mixing
from tests.llm.cases import ODD


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = sum(weight[s] for s in order if s not in full)
        rest = total - sum(cap * sizes[s] for s in full)
        more = {s for s in order if s not in full and cap * sizes[s] < rest * weight[s] / free} if free else set()
        if not more:
            return {s: cap * sizes[s] if s in full else rest * weight[s] / free for s in order}
        full |= more


def plain(rows, weights=(1, 2, 3)):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    targets, out = plain_targets(sizes, weights), []
    key = lambda r: (hashlib.md5(f"42:{'null' if r[0] is None else r[0]}".encode()).hexdigest(),
                     hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else "")
    for s in sizes:
        before, budget = 0, math.floor(targets[s])
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=key):
            n = size(t)
            taken = 0
            if sizes[s]:
                epochs, rest = divmod(budget, sizes[s])
                taken = epochs * n + min(max(rest - before, 0), n)
            out.append((i, n, sizes[s], targets[s], taken))
            before += n
    return sorted(out, key=str)


def docs(spark, rows):
    schema = "doc_id long, text string, source string, n_chars long"
    schema += ", size string, taken string, target string, before string"
    return spark.createDataFrame([(i, t, s, len(t or ""), None, None, None, None) for i, t, s in rows], schema)


CASES = {
    "even": [(k, "w " * (k % 7 + 1), f"s{k % 4}") for k in range(80)],
    "hot": [(k, "w " * 5, "hot" if k % 3 else f"s{k}") for k in range(90)],
    "capped": [(0, "w", "a"), (1, "w w", "b"), (2, "w " * 100, "c"), (3, "w w w", None), (4, "", "empty")],
    "odd": [(i, t, None if k % 5 == 0 else "éab"[k % 3]) for k, (i, t) in enumerate(ODD)],
    "one": [(1, "a b c", "x")],
    "wordless": [(1, "", "x"), (2, None, "y")],
}


@pytest.mark.parametrize("name", CASES)
def test_assigned(spark, name):
    rows = CASES[name]
    got = mixing.assigned(docs(spark, rows)).collect()
    found = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=str)
    want = plain(rows)
    assert [(*f[:3], f[4]) for f in found] == [(*w[:3], w[4]) for w in want]
    assert [f[3] for f in found] == pytest.approx([w[3] for w in want])
    assert all(f[4] <= 3 * f[1] for f in found)
    total = sum(f[1] for f in found)
    assert abs(sum(f[4] for f in found) - total) <= len({r[2] for r in rows})


def test_mixed_takes_what_is_assigned(spark):
    rows = [(k, f"first{k} " + "\n\t w é " * (k % 9), f"s{k % 5}") for k in range(100)]
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.assigned(docs(spark, rows)).collect()}
    out = mixing.mixed(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    found = defaultdict(list)
    for r in out.collect():
        found[r.doc_id].append(r.text)
    text = {i: t for i, t, _ in rows}
    for i, (n, words) in taken.items():
        assert sum(map(size, found[i])) == words
        cut = [t for t in found[i] if t != text[i]]
        assert len(cut) == (words % n > 0)
        assert all(text[i].startswith(t) for t in cut)


def test_running_sums_over_many_partitions(spark):
    rows = [(f"g{k % 3}", k * 7919 % 1000, k % 5) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = mixing.running(df, "g", ["k"], "v").collect()
    for g in ("g0", "g1", "g2"):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.k):
            assert r.before == total
            total += r.v


def test_empty(spark):
    assert mixing.assigned(docs(spark, [])).collect() == []
    assert mixing.mixed(docs(spark, [])).collect() == []
