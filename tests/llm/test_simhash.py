"""SimHash groups against a plain implementation."""

import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from sweepframe.llm import simhash
from sweepframe.llm.components import components
from tests.llm.cases import ODD, frame

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    """Smallest id reachable over fingerprints at most two bits apart."""
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        root[find(i)] = find(j)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    names = {r: min((i for i in v if i is not None), default=None) for r, v in least.items()}
    return [names[find(k)] for k in range(len(ids))]


def test_documents(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = plain_components([r["doc_id"] for r in rows], fps)
    got = simhash.groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, want)
    }


def test_odd_rows(spark):
    rows = ODD
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], fps)
    got = simhash.groups(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(
        ((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want)), key=key
    )


def test_empty(spark):
    assert simhash.groups(frame(spark, [])).collect() == []
    assert simhash.representatives(frame(spark, [])).collect() == []


def cluster(n, spread, seed):
    """Fingerprints around a few centres, and others far away."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, n // 2, dtype=np.uint64) << np.uint64(1)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    y = centre[rng.integers(0, 3, n - len(x))]
    for _ in range(spread):
        y = y ^ (np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64))
    return np.unique(np.concatenate([x, y]))


@pytest.mark.parametrize("n,spread", [(5, 1), (64, 2), (65, 3), (300, 2), (700, 4)])
def test_bit_slices(n, spread):
    one, two = cluster(n, spread, n), cluster(n // 2 + 2, spread, n + 1)
    fps = np.concatenate([one, two])
    a, b = simhash.links(fps, np.array([len(one), len(two)]))
    got = set(zip(a.tolist(), b.tolist()))
    block = np.repeat([0, 1], [len(one), len(two)])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    near &= block[:, None] == block[None, :]
    want = {(i, j) for i, j in zip(*(k.tolist() for k in np.nonzero(near))) if i < j}
    assert got == want
    assert len(a) == len(got)


@pytest.mark.parametrize("most", [4096, 8])
def test_blocks_lose_no_link(spark, most):
    fps = cluster(500, 3, 7)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = simhash.blocks(df, most)
    sizes = [len(r.fps) for r in found.collect()]
    assert max(sizes) <= most
    roots = {r.node: r.root for r in components(simhash.block_links(found)).collect()}
    groups = defaultdict(set)
    for f in fps.view(np.int64).tolist():
        groups[roots.get(f, f)].add(f)
    want = defaultdict(set)
    for c, f in zip(plain_components(list(range(len(fps))), fps.tolist()), fps.view(np.int64).tolist()):
        want[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_chain(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002), (1000, 1002), (7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {k: 0 for k in range(1, 201)} | {1001: 1000, 1002: 1000}


def test_representatives(spark):
    docs = frame(spark, [(3, "a b c d e"), (1, "a b c d e"), (2, "something else entirely here now"), (1, "a b c d e")])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [
        (1, "a b c d e"), (1, "a b c d e"), (2, "something else entirely here now")
    ]
