"""Exact duplicates against a plain implementation."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from sweepframe.llm import exact
from tests.llm.cases import ODD, frame


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    order = lambda i: (i is None, i)
    out = []
    for t, ids in groups.items():
        keep = min(ids, key=order)
        sha = hashlib.sha256(t.encode()).hexdigest()
        kept = [True] + [False] * (len(ids) - 1)
        out += [(i, keep, len(ids), k, sha) for i, k in zip(sorted(ids, key=order), kept)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def made_up(seed):
    """Texts that agree in length and head, in some blocks, or altogether."""
    rng = random.Random(seed)
    blocks = ["a" * 40, "b" * 40, "a" * 39 + "b", "é" * 40, "\U0001f600" * 40]
    rows = [(rng.randint(0, 99), "x" * 64 + "".join(rng.choices(blocks, k=rng.choice([0, 1, 2, 3, 7])))) for _ in range(150)]
    return rows + [(i, t.replace("x", "x \t", 1)) for i, t in rows[:20]] + [(i, t.replace("x", "x ", 1)) for i, t in rows[:9]]


@pytest.mark.parametrize("block", [7, 40, 4096])
def test_made_up(spark, block):
    rows = made_up(block)
    assert found(exact.groups(frame(spark, rows), block=block)) == plain(rows)


def test_odd_rows(spark):
    assert found(exact.groups(frame(spark, ODD))) == plain(ODD)


def test_distinct_keeps_rows_as_they_are(spark):
    rows = ODD + made_up(1)
    docs = frame(spark, rows)
    out = exact.distinct(docs, block=16)
    assert out.columns == docs.columns
    got = out.collect()
    want = sorted((str(i), sha) for i, _, _, kept, sha in plain(rows) if kept)
    assert sorted((str(r.doc_id), hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in got) == want
    assert {str(r) for r in got} <= {str(r) for r in docs.collect()}


def test_empty(spark):
    assert exact.groups(frame(spark, [])).collect() == []
    assert exact.distinct(frame(spark, [])).collect() == []
