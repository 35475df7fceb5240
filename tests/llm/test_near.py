"""The pipeline's near copies against all pairs of exact shingle sets."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from sweepframe.llm import near
from tests.llm.cases import ODD, frame

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similar(rows):
    """All pairs of places whose texts have a similarity of 0.8 or more."""
    sets, at, shared = [shingles(t) for _, t in rows], defaultdict(list), defaultdict(int)
    for k, s in enumerate(sets):
        for x in s:
            for j in at[x]:
                shared[j, k] += 1
            at[x].append(k)
    return {p for p, c in shared.items() if 10 * c >= 8 * (len(sets[p[0]]) + len(sets[p[1]]) - c)}


def smallest(rows, pairs):
    """Ids that no smaller one is connected to."""
    root = list(range(len(rows)))
    order = sorted(root, key=lambda k: rows[k][0])
    place = {k: i for i, k in enumerate(order)}
    least = {k: place[k] for k in root}
    changed = True
    while changed:
        changed = False
        for j, k in pairs:
            m = min(least[j], least[k])
            changed |= (least[j], least[k]) != (m, m)
            least[j] = least[k] = m
    return sorted(rows[k][0] for k in root if least[k] == place[k])


def check(rows, kept):
    """Exactly the smallest of linked rows stay."""
    pairs = similar(rows)
    assert sorted(kept) == smallest(rows, pairs)
    return pairs


def test_stage_drops_five_word_near_copies(spark):
    rows = {r["text"]: r["doc_id"] for r in reversed(pq.read_table(f"{SF}/documents.parquet").to_pylist())}
    rows = [(i, t) for t, i in rows.items()]
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    kept = [r.doc_id for r in stage(spark, frame(spark, rows, extra=False), SF).collect()]
    assert len(check(rows, kept)) > 4


def test_large_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    copies = [(k, " ".join(base[:60] + [f"x{k}"] + base[60:])) for k in range(300)]
    # half of the words are shared: candidates, but not near copies
    other = [(1000 + k, " ".join(base[:60] + [f"y{rng.randrange(10**6)}" for _ in range(40)])) for k in range(200)]
    rows = copies + other
    kept = [r.doc_id for r in near.representatives(frame(spark, rows)).collect()]
    assert sorted(kept) == [0] + [i for i, _ in other]


def test_odd_rows(spark):
    got = near.representatives(frame(spark, ODD)).collect()
    texts = sorted(((r.doc_id, r.text) for r in got), key=str)
    gone = [r for r in ODD if (r[0], r[1]) not in texts]
    assert sorted(gone, key=str) == sorted(
        [ODD[1], ODD[2], ODD[5], ODD[6], ODD[7], ODD[8], ODD[12], ODD[14]], key=str
    )
    assert near.representatives(frame(spark, [])).collect() == []


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_chains_connect(spark):
    """Links through a text that goes count: s-r and r-t are similar, s-t is not."""
    rng = random.Random(8)
    rows = []
    for k in range(20):
        r = words(rng, 220)
        s = r[:-1] + words(rng, 1)
        # 21 new shingles in front take the similarity of r and t to 0.8, of s and t below
        t = words(rng, 24) + r[24:]
        rows += [(3 * k, " ".join(s)), (3 * k + 1, " ".join(r)), (3 * k + 2, " ".join(t))]
    pairs = similar(rows)
    assert pairs == {(3 * k + a, 3 * k + b) for k in range(20) for a, b in ((0, 1), (1, 2))}
    for most in (near.BLOCK, 3):
        kept = [r.doc_id for r in near.representatives(frame(spark, rows), most=most).collect()]
        assert sorted(kept) == [3 * k for k in range(20)]


def near_group(rng, size, length, changed):
    """Texts made of one by changing up to so many words, at random places."""
    base, out = words(rng, length), []
    for k in range(size):
        w = list(base)
        for place in rng.sample(range(length), rng.randrange(changed)):
            w[place] = f"c{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_group_around_the_limit(spark):
    """A dense group with similarities on both sides of the limit, whole and cut into parts."""
    rng = random.Random(2)
    texts = near_group(rng, 150, 120, 9) + near_group(rng, 100, 20, 4) + near_group(rng, 60, 36, 4)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for most in (near.BLOCK, 40):
        kept = [r.doc_id for r in near.representatives(frame(spark, rows), most=most).collect()]
        assert len(check(rows, kept)) > 1000


def test_hot_bucket_of_dissimilar_texts(spark):
    """2,000 texts share a passage, and 400 are near copies of another: tasks return fewer
    rows than they were given."""
    rng = random.Random(6)
    passage = words(rng, 60)
    rows = [(k, " ".join(passage + words(rng, 40))) for k in range(2000)]
    rows += [(5000 + k, t) for k, t in enumerate(near_group(rng, 400, 100, 3))]
    found = {}
    whole = near.components
    near.components = lambda links: found.setdefault(len(found), whole(near.write_table(links, "seen").df))
    counts = []
    write = near.write_table

    def counted(df, label):
        out = write(df, label)
        counts.append((label, out.rows))
        return out

    near.write_table = counted
    try:
        kept = sorted(r.doc_id for r in near.representatives(frame(spark, rows)).collect())
    finally:
        near.components, near.write_table = whole, write
    assert kept[:2000] == list(range(2000)) and check(rows[2000:], kept[2000:])
    seen = [n for label, n in counts if label == "seen"]
    assert len(seen) == 2 and seen[0] <= near.BANDS * 2400 and seen[1] < 2400


def test_fingerprints_stay_within_the_radius():
    """Pairs at the limit, of all sizes that are compared by fingerprints."""
    rng = np.random.default_rng(3)
    for n in (32, 33, 40, 45, 90, 91, 500):
        for _ in range(200):
            shared = -(-8 * n // 9)
            x = rng.integers(0, 1 << 62, n).astype(np.uint64)
            y = np.append(x[:shared], rng.integers(0, 1 << 62, n - shared).astype(np.uint64))
            short = x[: -(-4 * n // 5)]
            sets = [x, y, short]
            fps = near.fingerprints(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])))
            assert near.simhash.distances(fps, np.array([0, 0]), np.array([1, 2])).max() <= near.RADIUS


def test_bit_sliced_words_against_popcounts():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (1, 16)).astype(np.uint64)
    flips = rng.random((300, 16, 64)) < rng.choice([0.02, 0.12, 0.2, 0.5], (300, 1, 1))
    fps = base ^ np.packbits(flips, axis=2, bitorder="little").view("<u8")[:, :, 0]
    sizes = np.array([1, 130, 64, 2, 103])
    block = np.repeat(np.arange(5), sizes)
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
    a, b = np.nonzero((far <= near.RADIUS) & (block[:, None] == block) & (np.arange(300)[:, None] < np.arange(300)))
    for pairs in (10, 200, 1 << 15):
        got = {(i, j) for x, y in near.simhash.near_pairs(fps, sizes, near.RADIUS, pairs) for i, j in zip(x.tolist(), y.tolist())}
        assert got == set(zip(a.tolist(), b.tolist()))


def test_pairs_at_the_limit_share_a_band():
    import pyarrow as pa

    texts = []
    for k in range(3000):
        w = [f"{k}w{j}" for j in range(204)]
        texts.append(" ".join(w))
        texts.append(" ".join(w[:-22] + [f"{k}v{j}" for j in range(22)]))
    named = near.bands(*near.shingle_sets(pa.array(texts, pa.large_string())))
    assert np.all((named[0::2] == named[1::2]).any(axis=1))
