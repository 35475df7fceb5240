"""Personal data against plain patterns and checksums."""

import hashlib
import re

import pyarrow.parquet as pq

from sweepframe.llm import pii
from tests.llm.cases import ODD, frame

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                or kind == "phone" and not 10 <= len(digits) <= 15
            ):
                continue
            out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def check(rows, got):
    want = sorted(
        (str(i), *(sum(s.startswith(k) for s in found) for k in PLAIN), hashlib.sha256(",".join(found).encode()).hexdigest())
        for i, found in ((i, plain(t)) for i, t in rows)
    )
    found = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    assert found == want
    for r in got:
        assert sum(s.split(":")[0] in PLAIN for s in r.spans.split(",")) == r.n_email + r.n_ip + r.n_card + r.n_phone


def test_documents(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
        check(rows, pii.digests(spark.read.parquet(f"{sf}/documents.parquet")).collect())


def test_odd_rows(spark):
    texts = [
        "a@b.c_d@e.f g@h i@j.k.l. x@y..z a@b.c@d.e",
        "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0255.1.1.1 000000000000000000000000000000000000000000001.1.1.1 999.1.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111 5 6",
        "+1 (555) 555-1234. +1 2 +123456789012345678 +1+4915112345678 +49.151.1234567-",
        "\U0001f600 é 4111111111111111 \U0001f600 a@b.cc",
        "a" * 30000 + "@", "1" * 30000, "a@b" + ".c" * 20000, "1 " * 20000, "+1" + " " * 30000, "1." * 20001,
        "+1 " * 5000, "a@b.c " * 3000,
    ]
    rows = ODD + [(100 + k, t) for k, t in enumerate(texts)]
    check(rows, pii.digests(frame(spark, rows)).collect())


def test_zero_parts_of_addresses(spark):
    texts = ["10.0.0.1", "0.0.0.0", "8.8.8.00", "192.168.0.1 127.0.0.1", "000.0001.0255.0", "0.0.0.256 1.0.0.0999", "1.00.10.100"]
    rows = list(enumerate(texts))
    got = pii.digests(frame(spark, rows)).collect()
    check(rows, got)
    assert {r.doc_id: r.n_ip for r in got} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 0, 6: 1}


def test_added_kinds(spark):
    rows = [
        (1, "Pay to GB82 WEST 1234 5698 7654 32, please"),
        (2, "Pay to GB82 WEST 1234 5698 7654 33, please"),
        (3, "DE89370400440532013000"),
        (4, "her SSN is 123-45-6789."),
        (5, "part 123-45-6789 of the list"),
    ]
    got = {r.doc_id: r.spans for r in pii.digests(frame(spark, rows)).collect()}
    assert got == {1: "iban:7:34", 2: "", 3: "iban:0:22", 4: "ssn:11:22", 5: ""}


def test_lists_behind_one_label(spark):
    rows = [
        (1, "SSN: 123-45-6789, 987-65-4321, 111-22-3333"),
        (2, "123-45-6789, 987-65-4321 (social security)"),
        (3, "SSN" + " " * 46 + "123-45-6789"),
        (4, "123-45-6789, 987-65-4321"),
        (5, "SSN: 123-45-6789" + " " * 40 + "987-65-4321"),
    ]
    got = {r.doc_id: r.spans for r in pii.digests(frame(spark, rows)).collect()}
    assert got == {
        1: "ssn:5:16,ssn:18:29,ssn:31:42", 2: "ssn:0:11,ssn:13:24", 3: "", 4: "", 5: "ssn:5:16"
    }


def test_account_numbers_before_capitals(spark):
    at, de = "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00"
    rows = [
        (1, f"{at} BIC"),
        (2, f"{at.replace(' ', '')} BANK CODE"),
        (3, f"{at} {de}"),
        (4, f"{de} BIC"),
        (5, f"{at}BANK"),
    ]
    got = {r.doc_id: r.spans for r in pii.digests(frame(spark, rows)).collect()}
    assert got == {1: "iban:0:24", 2: "iban:0:20", 3: "iban:0:24,iban:25:52", 4: "iban:0:27", 5: ""}
    assert {r.text for r in pii.masked(frame(spark, rows[:1])).collect()} == {"[iban] BIC"}


def test_context_adjusts_scores(spark):
    rows = [(1, "call +1 (555) 555-1234"), (2, "with +1 (555) 555-1234")]
    got = {r.doc_id: r.spans[0].score for r in pii.spans(frame(spark, rows)).collect()}
    assert got == {1: 0.85, 2: 0.6}


def test_very_many_matches_in_one_text(spark):
    """Memory is linear in the matches of a text."""
    text = "a@b.cc 10.0.0.1 " * 30_000 + "; 4111 1111 1111 1111" + " SSN 123-45-6789" * 6_000
    rows = [(1, text), (2, "x"), (3, text[16:])]
    got = {r.doc_id: r for r in pii.digests(frame(spark, rows)).collect()}
    assert [got[1][f"n_{k}"] for k in ("email", "ip", "card", "ssn")] == [30_000, 30_000, 1, 6_000]
    assert got[1].spans.startswith("email:0:6,ip:7:15,email:16:22")
    assert got[1].spans.endswith(f"ssn:{len(text) - 11}:{len(text)}")
    assert got[3].n_email == 29_999 and got[2].spans == ""


def test_masked_rows_that_share_an_id(spark):
    texts = ["plain text", "mail a@b.cc now", "mail a@b.cc now", None]
    rows = [(7, t) for t in texts] + [(None, t) for t in texts]
    got = pii.masked(frame(spark, rows).repartition(4)).collect()
    clean = ["plain text", "mail [email] now", "mail [email] now", None]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(i, t) for i in (7, None) for t in clean], key=str)


def test_masked(spark):
    docs = frame(spark, [(1, "to a@b.cc or 4111 1111 1111 1111!"), (2, "é"), (3, None), (None, "x")])
    got = pii.masked(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "to [email] or [card]!", 2: "é", 3: None, None: "x"}


def test_empty(spark):
    assert pii.digests(frame(spark, [])).collect() == []
