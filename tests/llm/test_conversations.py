"""Repaired conversations against a plain search over all edits."""

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import pyarrow.parquet as pq
import pytest

from sweepframe.llm import conversations, queries

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        out += [] if harm == 0 else [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def in_order(rows):
    def key(r):
        digest = hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
        return (r[1] is not None, r[1] or 0, digest)

    return sorted(rows, key=key)


def faults(rows):
    """'', b, d or t for each of the ordered rows."""
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.strip(SPACES)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows, marks):
    """Cost, audit and lines by trying everything after every state; strings are built whole."""

    @lru_cache(None)
    def go(i, state, inserts):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text = rows[i][2:]
            c, a, t = go(i + 1, state, 0)
            ways.append((2 + c, "D" + a, t))
            if marks[i] not in ("b", "d"):
                for edit, new, cost in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if (state, new[:1]) in NEXT:
                        c, a, t = go(i + 1, NEXT[state, new[:1]], 0)
                        ways.append((cost + 5 * (marks[i] == "t") + c, edit + a, (f"{new}:{text}", *t)))
        if inserts < 3:
            for new in ("user", "assistant"):
                if (state, new[0]) in NEXT:
                    c, a, t = go(i, NEXT[state, new[0]], inserts + 1)
                    ways.append((5 + c, "I" + a, (f"{new}:", *t)))
        return min(ways, default=(10**9, "", ()))

    return go(0, "", 0)


def want(rows, original):
    out = []
    for conv in dict.fromkeys(r[0] for r in original):
        mine = in_order([r for r in rows if r[0] == conv])
        marks = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, lines = cheapest(mine, marks)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, digest))
    return out


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_against_search(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    found = queries.op11_conversation_repair(spark, SF)
    assert found.columns == ["conv_id", *conversations.COUNTS, "cost", "audit", "repaired_sha256"]
    assert key(map(tuple, found.collect())) == key(want(damage(rows), rows))


def test_all_short_signatures_by_enumeration():
    """Every edit sequence is written out and judged by the grammar as a pattern."""
    grammar = re.compile("(s?(ua)+)?")
    symbols = "xsuaoSUAO"
    for n in range(4):
        for signature in itertools.product(symbols, repeat=n):
            best = {}

            def go(i, roles, audit, cost):
                if cost > 25:
                    return
                if i == n and grammar.fullmatch(roles):
                    best[cost] = min(best.get(cost, "Z"), audit)
                if len(roles) > 3 + n:
                    return
                for new in "ua":
                    if len(audit) - len(audit.replace("I", "")) < 3:
                        go(i, roles + new, audit + "I", cost + 5)
                if i < n:
                    x = signature[i]
                    go(i + 1, roles, audit + "D", cost + 2)
                    if x != "x":
                        more = 5 if x.isupper() else 0
                        go(i + 1, roles + x.lower(), audit + "K", cost + more)
                        for new in "ua":
                            go(i + 1, roles + new, audit + "R", cost + more + 1)

            if n < 3 or zlib.crc32("".join(signature).encode()) % 5 == 0:
                go(0, "", "", 0)
                cost = min(best)
                assert conversations.Path().read("".join(reversed(signature))) == (cost, best[cost]), signature


def test_common_ends_share_nodes():
    path = conversations.Path()
    ends = sorted({s[::-1] for s in ("uauaua", "suaua", "xuaua", "ua", "uaua", "suauA")})
    got = {e: path.read(e) for e in ends}
    # as many nodes as there are different ends
    assert path.made == len({e[:k] for e in ends for k in range(1, len(e) + 1)})
    assert got == {e: conversations.Path().read(e) for e in ends}


def table(spark, rows):
    names = "conv part place edit audit cost digest kind fault lost copy first none".split()
    schema = "conv_id long, turn long, role string, text string" + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([(*r, *(None for _ in names)) for r in rows], schema)


ODD = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 4, "user", "Hello there."),
    (1, 9, None, None), (2, None, "system", "Be kind."), (2, None, "user", "a "), (2, 3, "tool", "x?  \n"),
    (None, 0, "user", "hi!"), (None, None, "user", "hi!"), (None, 5, "", "t."), (3, None, None, None),
    (4, 2, "assistant", "long " * 40000 + "."), (4, 3, "user", "cut"), (4, 2, "user", "same turn."), (5, 7, "sys", "."),
    (6, 0, "user", ""), (6, 1, "user", "\t \n"), (7, -5, "assistant", "A."), (7, 5, "assistant", "B."),
]


def test_odd_rows(spark):
    many = ODD + [(100 + k, t, r, x) for k in range(60) for t, (_, _, r, x) in enumerate(ODD[k % 9 : k % 9 + 7])]
    found = conversations.digests(conversations.damaged(table(spark, many).repartition(5)))
    assert key(map(tuple, found.collect())) == key(want(damage(many), many))
    nothing = conversations.digests(conversations.damaged(table(spark, [])))
    assert nothing.collect() == [] and nothing.columns == found.columns


@pytest.mark.parametrize("hot", [5, None])
def test_a_conversation_with_a_third_of_all_rows(spark, hot):
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for k in range(10, 40) for t in range(4)]
    rows += [(hot, t % 700, "user", f"row {t % 50}" + "." * (t % 3 == 0)) for t in range(1500)]
    lost = table(spark, rows).selectExpr("conv_id conv", "turn", "role", "text", "false lost")
    out = [tuple(r)[:-1] for r in conversations.digests(lost).collect()]
    assert key(out) == key([r[:-1] for r in want_long(rows)])
    fixed = conversations.repaired(lost).where("conv <=> " + ("null" if hot is None else str(hot))).collect()
    roles = "".join(r.role[0] for r in sorted(fixed, key=lambda r: r.place))
    assert re.fullmatch("(s?(ua)+)?", roles) and [r.place for r in sorted(fixed, key=lambda r: r.place)] == [*range(len(fixed))]


def want_long(rows):
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20000)
    try:
        return want(rows, rows)
    finally:
        sys.setrecursionlimit(limit)
