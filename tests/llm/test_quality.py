"""Measurements, ledger and policies against a plain implementation."""

import re

import pyarrow.parquet as pq

from sweepframe.llm import quality
from tests.llm.cases import ODD, frame

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = re.findall(WORD, text)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


MORE = ODD + [
    (200, "w " * 50),
    (201, " ".join(f"w{k}" for k in range(30))),
    (202, " ".join(f"w{k} ###" for k in range(30))),
    (203, "\n".join(["a line of words"] * 9 + [f"w{k} here" for k in range(20)])),
    (204, " ".join("abcdefghijklmnopqrstuvwxyz" * 2 + str(k) for k in range(30))),
    (205, " ".join("abcdefghijklmno"[k : k + 1] for k in range(15)) * 2),
    (206, "a b c d e f g h " * 2 + "  x"),
]


def want(text):
    m = plain(text)
    bits = sum(1 << k for k, fails in enumerate(quality.RULES.values()) if fails(m))
    return m, bits


def test_ledger(spark):
    rows = MORE + [(r["doc_id"] + 1000, r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = quality.judge(quality.ledger(frame(spark, rows))).collect()
    found = sorted(
        (str(r.doc_id), *(r[m] for m in quality.MEASURES), r.fail_bits, r.base_failed, r.kept) for r in got
    )
    assert found == sorted(
        (str(i), *m.values(), bits, bits & 3 != 0, bits == 0) for i, (m, bits) in ((i, want(t)) for i, t in rows)
    )
    assert len({r.fail_bits for r in got}) > 4


def test_policies_and_ablations(spark):
    entries = quality.ledger(frame(spark, MORE))
    bits = [want(t)[1] for _, t in MORE]
    for policy, rules in quality.POLICIES.items():
        chosen = quality.mask(rules)
        kept = quality.judge(entries, policy).where("kept").count()
        assert kept == sum(not b & (chosen | 3) for b in bits)
        got = {r.rule: (r.documents, r.failed, r.only_this) for r in quality.ablations(entries, policy).collect()}
        assert got == {
            r: (len(bits), sum(bool(b & quality.mask([r])) for b in bits), sum(b & chosen == quality.mask([r]) for b in bits))
            for r in rules
        }


def test_accepted_keeps_rows_as_they_are(spark):
    docs = frame(spark, MORE)
    got = quality.accepted(docs)
    assert got.schema == docs.schema
    assert sorted(map(str, got.collect())) == sorted(
        str(r) for r in docs.collect() if not want(r.text)[1]
    )


def test_empty(spark):
    assert quality.judge(quality.ledger(frame(spark, []))).collect() == []
    assert quality.accepted(frame(spark, [])).collect() == []
