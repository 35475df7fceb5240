"""Repeated runs of lines against a plain implementation."""

import random
import re

import numpy as np
import pytest

from sweepframe.llm import lines
from tests.llm.cases import ODD, frame


def windows(every, spoken, run, words):
    """Places, sizes and lines of all windows that count."""
    for at in range(len(spoken)):
        for size in range(1, run + 1):
            part = tuple(every[k] for k in spoken[at : at + size])
            if len(part) == size and (size == run or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in part) >= words):
                yield at, size, part


def plain(rows, run=3, words=lines.WORDS):
    first, docs = {}, []
    for i, text in rows:
        num = (i is None, "" if i is None else i)
        every = (text or "").split("\n")
        spoken = [k for k, x in enumerate(every) if re.search(r"[^\x20\x09-\x0D]", x)]
        docs.append((i, num, every, spoken))
        for at, _, part in windows(every, spoken, run, words):
            first[part] = min(first.get(part, (num, at)), (num, at))
    out = []
    for i, num, every, spoken in docs:
        gone = set()
        for at, size, part in windows(every, spoken, run, words):
            if first[part] < (num, at):
                gone.update(spoken[at : at + size])
        out.append((i, len(spoken), len(gone), "\n".join(x for k, x in enumerate(every) if k not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,letters,run", [(1, "ab", 3), (2, "abcdef", 3), (3, "abcdef ", 2), (4, ["", "é x", "y", " "], 4)])
def test_made_up(spark, seed, letters, run):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 60), "\n".join(rng.choices(letters, k=rng.randint(0, 25)))) for _ in range(80)]
    want = plain(rows, run)
    assert sum(r[2] for r in want) > 0
    assert found(lines.without_repeats(frame(spark, rows), run=run)) == want


@pytest.mark.parametrize("seed,words", [(5, 4), (6, 25)])
def test_few_lines_with_many_words(spark, seed, words):
    """Repeated lines and pairs of lines go if they are long, and stay if they are not."""
    rng = random.Random(seed)
    stock = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 2 * words))) for _ in range(12)]
    rows = [(k, "\n".join([f"own {k} {j} {rng.choice(stock)}" if rng.random() < 0.4 else rng.choice(stock) for j in range(6)])) for k in range(60)]
    want = plain(rows, words=words)
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)
    assert found(lines.without_repeats(frame(spark, rows), words=words)) == want


def test_long_lines_go_and_stock_lines_stay(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"a b\n{long}"), (2, f"c\na b\nd\n{long}"), (3, long), (4, "a b"), (None, f"{long}\nx"), (None, f"y\n{long}")]
    got = found(lines.without_repeats(frame(spark, rows)))
    assert got == plain(rows)
    assert [(r[0], r[2]) for r in got] == [(1, 0), (2, 1), (3, 1), (4, 0), (None, 1), (None, 1)]


def test_ids_of_any_type_and_rows_without_one(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [("b", f"x\n{long}"), ("a", f"{long}\ny"), ("b", long), *[(None, f"{k}\n{long}\n{k}") for k in range(200)]]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    got = found(lines.without_repeats(docs))
    assert got == plain([(i, t) for i, t in rows])


def test_odd_rows(spark):
    assert found(lines.without_repeats(frame(spark, ODD))) == plain(ODD)


def test_empty(spark):
    assert lines.without_repeats(frame(spark, [])).collect() == []


def test_equal_windows_select_the_same_line():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 6, 400)
    windows = np.arange(400 - 4)
    best = lines.selected(hashes, windows, 5)
    chosen = {}
    for w, b in zip(windows, best):
        assert chosen.setdefault(tuple(hashes[w : w + 5]), b - w) == b - w
        assert hashes[b] == min(hashes[w : w + 5])
