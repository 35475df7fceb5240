"""Repeated word windows against a plain implementation."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sweepframe.llm import batches, substrings
from tests.llm.cases import ODD, frame


def plain(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [substrings.NO_ID if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), num, w in zip(rows, ids, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < num:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def made_up(seed, n=150, size=120, letters="abcd"):
    """Texts of few words with copied passages, runs and whole copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = rng.choices(letters, k=rng.randint(0, size))
        for _ in range(rng.randint(0, 3)):
            if rows:
                other = (rng.choice(rows)[1] or "").split()
                a = rng.randint(0, len(other))
                at = rng.randint(0, len(w))
                w[at:at] = other[a : a + rng.randint(1, 40)]
        if rng.random() < 0.2:
            at = rng.randint(0, len(w))
            w[at:at] = [rng.choice(letters)] * rng.randint(5, 60)
        rows.append((rng.randint(0, n), " ".join(w)))
        if rng.random() < 0.2:
            rows.append((rng.randint(0, n), rows[-1][1]))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefgh"), (3, [f"w{k}" for k in range(300)])])
def test_made_up(spark, seed, letters):
    rows = made_up(seed, letters=letters)
    want = plain(rows)
    assert sum(r[2] for r in want) > 0
    assert found(substrings.without_repeats(frame(spark, rows))) == want


def test_small_slices_and_frequent_surroundings(spark, monkeypatch):
    """Nothing is settled early, and all surroundings count as frequent."""
    monkeypatch.setattr(batches, "SLICE_BYTES", 1)
    monkeypatch.setattr(batches.slices, "__defaults__", (1,))
    rows = made_up(4, n=60)
    want = plain(rows)
    docs = frame(spark, rows)
    assert found(substrings.without_repeats(docs)) == want
    around = [
        k
        for _, t in rows
        for k in substrings.filed(substrings.Texts(batches.as_text(pa.array([t]))), 13)[0].view(np.int64).tolist()
    ]
    monkeypatch.setattr(substrings, "_frequent", lambda docs, window: sorted(set(around)))
    assert found(substrings.without_repeats(docs)) == want


def test_odd_rows(spark):
    assert found(substrings.without_repeats(frame(spark, ODD))) == plain(ODD)


def test_longer_windows(spark):
    rows = made_up(5, n=60)
    assert found(substrings.without_repeats(frame(spark, rows), window=20)) == plain(rows, 20)
    with pytest.raises(ValueError):
        substrings.without_repeats(frame(spark, rows), window=5)


def test_empty(spark):
    assert substrings.without_repeats(frame(spark, [])).collect() == []


def test_cuts_depend_on_their_surroundings_only():
    """A cut in one text is a cut in every text that holds the words it depends on."""
    rng = random.Random(7)
    core = rng.choices("abcdef", k=60)
    seen = []
    for _ in range(30):
        left, right = rng.choices("abcdef", k=rng.randint(0, 9)), rng.choices("abcdef", k=rng.randint(0, 9))
        text = substrings.Texts(batches.as_text(pa.array([" ".join(left + core + right)])))
        levels = []
        for start, lo, hi, seam in substrings.cuts(text.names, text.inside):
            shift = 1 + len(left)
            inside = (lo >= shift) & (hi <= shift + len(core))
            levels.append(
                [x.tolist() for x in (start[inside] - shift, lo[inside] - shift, hi[inside] - shift, seam[inside])]
            )
        seen.append(levels)
    assert all(s == seen[0] for s in seen)
    assert seen[0][-1][0]
