"""The registered queries and the pipeline on the smallest tables."""

import random

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from checks.compare import connect, difference
from sweepframe.llm.queries import ORACLE, QUERIES, vocabulary
from tests.llm import test_exact, test_mixing, test_near, test_quality, test_tokens
from tests.llm.cases import frame

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in ORACLE:
        assert difference(got, connect(SF).execute(ORACLE[name]).df()) == ""


def plain(rows):
    """(id, source, ids) of what the stages leave, one after the other."""
    rows = [r for r in rows if not test_quality.want(r[1])[1]]
    first = {}
    for i, t, _ in rows:
        first[test_exact.norm(t)] = min(first.get(test_exact.norm(t), i), i)
    rows = [r for r in rows if first[test_exact.norm(r[1])] == r[0]]
    texts = [(i, t) for i, t, _ in rows]
    stay = set(test_near.smallest(texts, test_near.similar(texts)))
    rows = [r for r in rows if r[0] in stay]
    taken = {i: words for i, _, _, _, words in test_mixing.plain(rows)}
    out = []
    for i, t, s in rows:
        n, words = test_mixing.size(t), taken[i]
        while words > 0:
            whole = words >= n
            out.append((i, s, t if whole else first_words(t, words)))
            words -= n
    return out


def first_words(text, n):
    import re

    return text[: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)][n - 1]]


def test_pipeline(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    want = plain(rows)
    ids, _ = test_tokens.library_ids([t for _, _, t in want])
    out = corpus_pipeline.run(spark, SF)
    got = sorted((r.doc_id, r.source, r.n_chars, r.ids) for r in out.collect())
    assert got == sorted((i, s, len(t), x) for (i, s, t), x in zip(want, ids))
    assert 0 < len({g[0] for g in got}) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_odd_rows(spark):
    """NULLs, empty texts, repeated rows and ids, ties, near copies, clashing columns."""
    rng = random.Random(11)

    def text(n):
        return " ".join(f"word{rng.randrange(10**6)}" for _ in range(n))

    base, other, third = text(80), text(60), text(45)
    near_copy = " ".join(base.split()[:-1] + ["changed"])
    rows = [
        (5, base), (2, base), (2, base), (3, base.replace(" ", "  \n")), (1, near_copy), (None, near_copy + " more"),
        (None, other), (9, other), (9, text(50)), (None, third), (None, third), (7, None), (8, ""), (10, " \t\n"),
        (11, text(3)), (None, None), (12, "long " * 3000), (13, text(20000)),
    ]
    docs = frame(spark, rows).repartition(3)
    kept = [(1, near_copy), (9, other), (9, rows[8][1]), (None, third), (13, rows[-1][1])]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    assert docs.columns == frame(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(kept, key=str)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    texts = {t for _, t in kept}
    for r in mixed.collect():
        assert any(t.startswith(r.text) for t in texts) and r.n_chars == len(r.text)
    ids = corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()
    assert len(ids) == mixed.count() and all(r.ids for r in ids)


def test_vocabulary_files_exist():
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(vocabulary(name), "rb") as f:
            assert f.read(1)
