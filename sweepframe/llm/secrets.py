"""Secrets: three fixed patterns, and strings that look random for their encoding and length.

The patterns' matches are always reported. Beyond them, every run of at least ``SHORTEST``
characters of the base-64 alphabets that overlaps no match is a candidate. Its encoding is
the smallest alphabet that holds it; in that alphabet three tests are made of it: uniform
counts (chi-squared), runs above and below the middle, serial correlation. A candidate that
the three together (Fisher) show to be uneven is ordinary. For the others it is asked how
often an ordinary string of the same length, whose characters are as unequal as those of
language, would come out as even: short strings often, long ones never. These p-values are
held against all candidates of the corpus of the same encoding and length class
(Benjamini-Hochberg), so that a corpus with millions of ordinary strings does not yield
thousands of false finds. They are counted in steps of a quarter of a power of two, rounded
up; the counts are a small table of fixed size.

Defined results: a NULL text is empty; a row without finds has zero counts and an empty
list; equal rows give equal rows; empty tables give empty results; other columns are
ignored. Places count characters, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.llm import batches
from sweepframe.llm.bpe import spread
from sweepframe.session import write_table

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: One of these stands, in any case, in every text that ASSIGN matches.
ASSIGN_NEEDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

SHORTEST = 20
#: Candidates whose evenness is rejected at this level are ordinary.
UNEVEN = 0.01
#: Part of the reported strings that may be ordinary, in each class.
FALSE = 0.05
#: Chance that two characters of ordinary text are equal: letters of a language, digits.
LANGUAGE, DIGITS = 0.0667, 0.1
#: Steps of p-values to a power of two, and the last step.
STEPS, LAST = 4, 240
#: Length classes: powers of two.
LENGTHS = 40
#: Candidates tested at a time.
TESTED = 1 << 14

_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet on, in the order of their codes.
ENCODINGS = {
    "hex": _DIGIT + _LOWER[:6],
    "HEX": _DIGIT + _UPPER[:6],
    "base32": _UPPER + _DIGIT[2:8],
    "lower": _DIGIT + _LOWER,
    "upper": _DIGIT + _UPPER,
    "letters": _UPPER + _LOWER + _DIGIT,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "base64url": _UPPER + _LOWER + _DIGIT + "-_",
    "mixed": _UPPER + _LOWER + _DIGIT + "+/-_",
}
SIZES = np.array([len(a) for a in ENCODINGS.values()])
SAME = np.array([DIGITS if name.lower() == "hex" else LANGUAGE for name in ENCODINGS])
CODES = np.full((len(ENCODINGS), 256), -1, np.int8)
for _row, _alphabet in zip(CODES, ENCODINGS.values()):
    _row[np.frombuffer(_alphabet.encode(), np.uint8)] = np.arange(len(_alphabet))
#: Per byte: a bit for each encoding that lacks it, and one more if it is no digit.
LACKS = (((CODES < 0) << np.arange(len(ENCODINGS))[:, None]).sum(0)).astype(np.int16)
LETTER = np.ones(256, bool)
LETTER[np.frombuffer(_DIGIT.encode(), np.uint8)] = False
HEX = CODES[0] >= 0
INSIDE = CODES[-1] >= 0


def upper_tail(z: np.ndarray) -> np.ndarray:
    """Chance that a normal variable exceeds ``z``."""
    return 0.5 * np.fromiter(map(math.erfc, (z / math.sqrt(2)).tolist()), np.float64, len(z))


# -- tests ----------------------------------------------------------------------------


def tested(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class (encoding and length) and step of the p-value of each string; the strings
    stand one after the other in ``flat``. Strings of digits alone have class -1."""
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    lacks = np.bitwise_or.reduceat(LACKS[flat], first)
    fits = (lacks[:, None] >> np.arange(len(ENCODINGS)) & 1) == 0
    encoding = fits.argmax(1)
    codes = CODES[encoding[owner], flat].astype(np.int64)
    k, n = SIZES[encoding].astype(float), sizes.astype(float)

    counts = np.bincount(owner * 66 + codes, minlength=66 * len(sizes)).reshape(-1, 66)
    chi = k / n * (counts.astype(float) ** 2).sum(1) - n
    df = k - 1
    # Wilson and Hilferty
    even = upper_tail((np.cbrt(chi / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))

    high = 2 * codes >= SIZES[encoding][owner]
    same = owner[1:] == owner[:-1]
    changes = np.bincount(owner[1:][same & (high[1:] != high[:-1])], minlength=len(sizes))
    runs = 2 * upper_tail(np.abs(changes - (n - 1) / 2) / np.sqrt((n - 1) / 4))

    centred = codes - (k[owner] - 1) / 2
    products = np.bincount(owner[1:][same], (centred[1:] * centred[:-1])[same], minlength=len(sizes))
    serial = 2 * upper_tail(np.abs(products) / ((k**2 - 1) / 12 * np.sqrt(n - 1)))

    x = -sum(np.log(np.maximum(p, 1e-300)) for p in (even, runs, serial))
    together = np.exp(-x) * (1 + x + x**2 / 2)

    unequal = n * (k * SAME[encoding] - 1)
    ordinary = upper_tail((df + unequal - chi) / np.sqrt(2 * df + 4 * unequal))
    step = np.floor(-STEPS * np.log2(np.maximum(ordinary, 1e-300))).clip(0, LAST).astype(np.int64)
    step[together < UNEVEN] = 0
    kind = encoding * LENGTHS + np.frexp(n)[1] - 1
    kind[~np.logical_or.reduceat(LETTER[flat], first)] = -1
    return kind, step


# -- spans ----------------------------------------------------------------------------


def _patterns(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(kind, start, end)`` in bytes of the valid matches of the written patterns."""
    every = data.tobytes()
    lower = every.lower()
    bounds = offsets.tolist()
    needed = any(x in lower for x in ASSIGN_NEEDS)
    access = b"AKIA" in every
    if not (needed or access):
        return
    for start, end in zip(bounds, bounds[1:]):
        if needed and any(lower.find(x, start, end) >= 0 for x in ASSIGN_NEEDS):
            for m in ASSIGN.finditer(every, start, end):
                if m.end(1) - m.start(1) >= LEAST["assign"]:
                    yield 0, m.start(), m.end()
        if access and every.find(b"AKIA", start, end) >= 0:
            for m in ACCESS.finditer(every, start, end):
                if m.end() - m.start() >= LEAST["access"]:
                    yield 1, m.start(), m.end()


def find(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """``text, kind, start, end, class, step`` of all matches and candidates, in order
    of text, start and kind; class and step are -1 for matches."""
    data, offsets = batches.raw(texts)
    written = np.array(list(_patterns(data, offsets)), np.int64).reshape(-1, 3)
    starts, ends = batches.tokens(HEX[data], offsets)
    long = ends - starts >= LEAST["hex"]
    hexes = np.stack([np.full(long.sum(), 2), starts[long], ends[long]], 1)
    base = np.concatenate([written, hexes])
    starts, ends = batches.tokens(INSIDE[data], offsets)
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    if len(base) and len(starts):
        order = np.argsort(base[:, 1], kind="stable")
        reach = np.maximum.accumulate(base[order, 2])
        before = np.searchsorted(base[order, 1], ends) - 1
        free = (before < 0) | (reach[np.maximum(before, 0)] <= starts)
        starts, ends = starts[free], ends[free]
    kinds, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(starts), TESTED):
        part = slice(at, at + TESTED)
        size = ends[part] - starts[part]
        kind, step = tested(data[spread(starts[part], size)], size)
        kinds.append(kind)
        steps.append(step)
    kind, step = np.concatenate(kinds), np.concatenate(steps)
    some = kind >= 0
    added = np.stack([np.full(some.sum(), 3), starts[some], ends[some]], 1)
    none = np.full(len(base), -1)
    kind, step = np.concatenate([none, kind[some]]), np.concatenate([none, step[some]])
    found = np.concatenate([base, added])
    order = np.lexsort((found[:, 0], found[:, 1]))
    found, kind, step = found[order], kind[order], step[order]
    text = np.searchsorted(offsets, found[:, 1], "right") - 1
    start, end = _characters(data, offsets[text], found[:, 1], found[:, 2])
    return text, found[:, 0], start, end, kind, step


def _characters(data: np.ndarray, zero: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in characters from ``zero`` on, of places in bytes."""
    if len(starts) == 0:
        return starts, ends
    places = np.unique(np.concatenate([[0], zero, starts, ends[ends < len(data)]]))
    between = np.add.reduceat((data & 0xC0) != 0x80, places, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(between)])
    places = np.append(places, len(data))

    def at(x: np.ndarray) -> np.ndarray:
        return before[np.searchsorted(places, x)]

    return at(starts) - at(zero), at(ends) - at(zero)


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``spans`` (``k, start, end, class, step``) per row of ``docs``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                text, *columns = find(batches.as_text(part.column("text")))
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                names = ["k", "start", "end", "class", "step"]
                items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
                spans = pa.ListArray.from_arrays(pa.array(bounds), items)
                yield pa.RecordBatch.from_arrays([part.column("id"), spans], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = "struct<k:long,start:long,end:long,class:long,step:long>"
    return source.mapInArrow(run, f"id {kind}, spans array<{span}>")


def limits(found: DataFrame) -> dict[int, int]:
    """Per class the smallest step that is reported, for classes with any.

    The result has at most a number for each encoding and power of two.
    """
    rows = found.select(F.inline("spans")).where("class >= 0").groupBy("class", "step").count()
    by_class = Window.partitionBy("class")
    upto = by_class.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "class", "step", F.sum("count").over(upto).alias("found"), F.sum("count").over(by_class).alias("all")
    )
    most = F.pow(F.lit(2.0), -F.col("step") / STEPS) * F.col("all")
    chosen = rows.where(most <= FALSE * F.col("found")).groupBy("class").agg(F.min("step").alias("step"))
    return {r["class"]: r.step for r in chosen.collect()}


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its spans (``kind, start, end, encoding, p``) in order of start
    and kind; encoding and the p-value are NULL for the written patterns. Runs jobs."""
    found = write_table(_candidates(docs, id_col, text_col), "candidates").df
    least = limits(found)
    steps = F.array(*(F.lit(least.get(c, LAST + 1)) for c in range(len(ENCODINGS) * LENGTHS)))
    names, encodings = F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, ENCODINGS))

    def shown(s: Column) -> Column:
        added = s["class"] >= 0
        return F.struct(
            names[s.k].alias("kind"),
            s.start.alias("start"),
            s.end.alias("end"),
            F.when(added, encodings[F.floor(s["class"] / LENGTHS)]).alias("encoding"),
            F.when(added, F.pow(F.lit(2.0), -s.step / STEPS)).alias("p"),
        )

    kept = F.filter("spans", lambda s: F.when(s["class"] < 0, True).otherwise(s.step >= steps[s["class"]]))
    return found.select(F.col("id").alias(id_col), F.transform(kept, shown).alias("spans"))


def _written(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: spans counted by written pattern and written out. Runs jobs."""
    items = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(items, lambda s: s.kind == kind)).cast("long")

    base = F.filter(items, lambda s: s.kind.isin(*BASE))
    return spans(docs, id_col, text_col).select(
        id_col,
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(items).alias("spans"),
    )
