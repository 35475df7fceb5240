"""Secrets against plain patterns and tests, and by planted random and ordinary strings."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from sweepframe.llm import queries, secrets
from tests.llm.cases import ODD, frame

SF = "/root/testdata/sf0.01"


def base_spans(text):
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    word += "|[aA][pP][iI]_?[kK][eE][yY]"
    out = []
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def battery(s):
    """Class and step of one string by sums over its characters."""
    if s.isdigit():
        return None
    e, alphabet = next((k, a) for k, a in enumerate(secrets.ENCODINGS.values()) if set(s) <= set(a))
    k, n = len(alphabet), len(s)
    codes = [alphabet.index(c) for c in s]
    chi = sum((Counter(codes)[c] - n / k) ** 2 / (n / k) for c in range(k))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    h = 2 / (9 * (k - 1))
    p = [tail(((chi / (k - 1)) ** (1 / 3) - 1 + h) / math.sqrt(h))]
    runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(codes, codes[1:]))
    p.append(2 * tail(abs(runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4)))
    m = (k - 1) / 2
    serial = sum((a - m) * (b - m) for a, b in zip(codes, codes[1:]))
    p.append(2 * tail(abs(serial) / ((k * k - 1) / 12) / math.sqrt(n - 1)))
    x = -sum(math.log(max(q, 1e-300)) for q in p)
    together = math.exp(-x) * (1 + x + x * x / 2)
    more = n * (k * (0.1 if e < 2 else 0.0667) - 1)
    z = (chi - (k - 1) - more) / math.sqrt(2 * (k - 1) + 4 * more)
    ordinary = max(tail(-z), 1e-300)
    step = min(240, math.floor(4 * math.log2(1 / ordinary)))
    return (e, n.bit_length() - 1), step if together >= 0.01 else 0


def plain(rows):
    """Base spans and all spans of each text."""
    candidates, bases = [], []
    for j, text in enumerate(rows):
        base = base_spans(text)
        bases.append(base)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
            if not any(s < m.end() and m.start() < e for s, _, e in base) and (found := battery(m[0])):
                candidates.append((j, m.start(), m.end(), *found))
    by_class = {}
    for _, _, _, kind, step in candidates:
        by_class.setdefault(kind, []).append(step)
    least = {}
    for kind, steps in by_class.items():
        ok = [s for s in set(steps) if 2 ** (-s / 4) * len(steps) <= 0.05 * sum(t >= s for t in steps)]
        least[kind] = min(ok, default=999)
    every = [list(b) for b in bases]
    for j, start, end, kind, step in candidates:
        if step >= least[kind]:
            every[j].append((start, 3, end))
    return bases, [sorted(x) for x in every]


def written(items):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in items)


def want(rows):
    out = []
    for (i, _), base, every in zip(rows, *plain([t for _, t in rows])):
        n = [sum(k == x for _, x, _ in every) for k in range(4)]
        out.append((i, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
    return sorted(out, key=str)


def test_query_against_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = sorted(map(tuple, queries.op12_secret_scan(spark, SF).collect()), key=str)
    assert got == want(rows)
    assert sum(r[1] for r in got) > 0


def token(rng, n, alphabet):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_odd_rows(spark):
    rng = random.Random(4)
    url = secrets.ENCODINGS["base64url"]
    rows = ODD + [
        (20, "paſſword=abcdefgh1 toKen: abcdefgh12 TOKEN = 'abc.def-gh' token='short' secret=token=abcdefgh"),
        (21, "é\U0001f600 AKIA0123456789AB AKIAAKIAAKIA AKIA" + "Z" * 30 + " xAKIA123456789012b"),
        (22, "é" + "0123456789abcdef" * 2 + "G" + "a" * 31 + " " + "b" * 32),
        (23, 'API_KEY : "' + token(rng, 40, url) + '" apikey=' + token(rng, 7, url) + " Api__Key=12345678"),
        (24, " ".join(token(rng, 60, url) for _ in range(30)) + " " + "1" * 50),
        (25, "token" + " " * 100000 + "=x token:" + "y" * 100000),
        (26, ("password=12345678 AKIA" + "0" * 12 + " ") * 3000),
        (27, "token token token=:abcdefgh secret\n=abcdefgh passwd\" : 'a/b+c=d-"),
    ]
    got = secrets.digests(frame(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)
    assert secrets.digests(frame(spark, [])).collect() == []


def test_batches_of_random_strings_against_plain_tests():
    rng = random.Random(9)
    strings = [token(rng, rng.choice([20, 21, 33, 64, 500]), a) for a in secrets.ENCODINGS.values() for _ in range(30)]
    strings += ["a" * 20, "ab" * 30, "createWindowSurfaceFromHandle", "/usr/share/locale/messages/some", "0" * 32 + "x"]
    flat = np.frombuffer("".join(strings).encode(), np.uint8)
    kind, step = secrets.tested(flat, np.array([len(s) for s in strings]))
    for s, c, j in zip(strings, kind, step):
        (e, size), k = battery(s)
        assert c == e * secrets.LENGTHS + size and j == k


def test_random_strings_are_found_and_ordinary_ones_are_left():
    """Of what is reported in a corpus of mostly ordinary strings, few are ordinary."""
    rng = random.Random(1)
    words = re.findall("[a-z]{3,}", " ".join(r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()[:300]))
    joins = [lambda w: "".join(x.capitalize() for x in w), "_".join, "-".join, "/".join, lambda w: "".join(w) + str(rng.randrange(999))]
    ordinary = [rng.choice(joins)([rng.choice(words) for _ in range(rng.randrange(4, 9))]) for _ in range(5000)]
    secret = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(200)]
    secret += [base64.urlsafe_b64encode(rng.randbytes(48)).decode() for _ in range(200)]
    secret += [token(rng, 40, secrets.ENCODINGS["letters"]) for _ in range(200)]
    texts = ordinary + secret
    bases, every = plain(texts)
    found = [any(k == 3 for _, k, _ in spans) for spans in every]
    false, true = sum(found[:5000]), sum(found[5000:])
    assert true >= 0.9 * len(secret) and false <= 0.1 * (false + true)
    text, kind, *_ = secrets.find(pa.array(texts, pa.large_string()))
    assert set(text[kind == 3]) >= {j for j, f in enumerate(found) if f}
