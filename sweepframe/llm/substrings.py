"""Repeated word sequences, found by recompression.

A text is a sequence of word names. Recompression shortens it in rounds: runs of one
name become a symbol, then neighbours whose names fall on the left and right side of a
fixed split of all names become a symbol, then those again. A symbol's name is computed
from what it stands for, so it is the same in every text and no round has to gather
names. Whether two symbols are cut apart depends on a few words around the cut only;
equal sequences are therefore cut alike except near their ends.

A window of 13 words always holds a cut whose surroundings lie inside the window. Each
window is filed under one such cut (of the highest round, then the smallest hash), so
equal windows are filed under equal surroundings. One row stands for all windows next to
each other that are filed under the same cut: the name of the surroundings, the name of
all words of these windows, the document and the place.

1. Rows are dealt by the name of the surroundings and sorted. Rows with all words equal
   are settled at once: all but those of the smallest document are repeats. Surroundings
   with several different rows leave one of each, the smallest document's.
2. The texts are joined with their rows. Documents with rows that are left list their
   windows by 128-bit names, the others are finished.
3. The smallest document of each listed window settles the rest.

Surroundings so frequent that a sample of the documents shows them are dealt by the
name of all words instead, and their rows are left for step 2; within a slice of the
input, equal rows are settled before the shuffle. So neither copies nor frequent phrases
gather in a task. All names are 64-bit hashes, of which a decision needs two to agree.

Defined results: a NULL text has no words; NULL ids count as larger than all others, and
rows that share an id as one document, each with its own words; texts with fewer words
than a window keep all; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm import batches
from sweepframe.llm.bpe import spread
from sweepframe.session import write_table

WINDOW = 13
ROUNDS = 2
#: Share of the documents in which frequent surroundings are looked for.
SAMPLE = 0.01
NO_ID = (1 << 63) - 1

U = np.uint64
BASE, AGAIN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Well distributed 64-bit numbers, one for each number."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Ranges:
    """Names of ranges of words, from sums of the words' names times powers."""

    def __init__(self, names: np.ndarray, base: int) -> None:
        n = len(names)
        powers = np.full(n + 1, base, U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), U)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        self.back = inverse
        self.upto = np.zeros(n + 1, U)
        np.cumsum(names * powers[:-1], out=self.upto[1:])

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.upto[end] - self.upto[start]) * self.back[start] ^ (end - start).astype(U))


class Texts:
    """Word names of a slice, with a place of its own before and behind each text."""

    def __init__(self, texts: pa.Array) -> None:
        import xxhash

        self.words = w = batches.words(texts)
        code, distinct = w.named()
        hashes = np.array([xxhash.xxh3_64_intdigest(d) for d in distinct], U)
        # the word with number k of text i is at k + i + 1
        self.shift = np.arange(w.texts) + 1
        self.place = np.arange(len(w)) + np.repeat(self.shift, w.counts)
        self.names = np.zeros(len(w) + w.texts + 1, U)
        self.names[self.place] = hashes[code]
        self.inside = np.zeros(len(self.names), bool)
        self.inside[self.place] = True

    def starts(self, window: int) -> np.ndarray:
        """Places at which a window of words begins inside a text."""
        w = self.words
        return spread(w.first[:-1] + self.shift, np.maximum(w.counts - window + 1, 0))

    def text_of(self, place: np.ndarray) -> np.ndarray:
        """The text that holds each place."""
        return np.searchsorted(self.words.first[:-1] + self.shift, place, "right") - 1

    def number(self, place: np.ndarray, text: np.ndarray) -> np.ndarray:
        """A place as the number of a word of its text."""
        return place - (self.words.first[:-1] + self.shift)[text]


def cuts(names: np.ndarray, inside: np.ndarray, rounds: int = ROUNDS):
    """For each round: where symbols begin, the range of places each beginning depends
    on, and a hash of the symbols on its sides. The first round has runs, the others
    pairs. Places outside texts are symbols that never join others."""
    n = len(names)
    start = lo = hi = np.arange(n)
    out = []
    for round_ in range(rounds + 1):
        if round_ == 0:
            joins = (names[1:] == names[:-1]) & inside[1:] & inside[:-1]
        else:
            right = (mix(names ^ U(round_ * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> U(63)).astype(bool)
            joins = ~right[:-1] & right[1:] & inside[1:] & inside[:-1]
        end = np.append(start[1:], n)
        cut = np.ones(len(start), bool)
        cut[1:] = ~joins
        # a cut depends on the symbols on both sides, that is on where those begin and end
        before, behind = np.append(lo[:1], lo[:-1]), np.append(hi[1:], hi[-1:])
        sides = np.minimum(np.append(start[:1], start[:-1]), before), np.maximum(end, behind)
        lo, hi = np.minimum(lo, sides[0])[cut], np.maximum(hi, sides[1])[cut]
        seam = mix(np.append(U(0), names[:-1]) * U(AGAIN) + names)[cut]
        head = np.flatnonzero(cut)
        size = np.diff(np.append(head, len(names)))
        if round_ == 0:
            joined = np.where(size > 1, mix(names[head] + size.astype(U)), names[head])
        else:
            second = np.append(names, U(0))[head + 1]
            joined = np.where(size > 1, mix(names[head] * U(BASE) + second), names[head])
        names, inside, start = joined, inside[head], start[head]
        out.append((start, lo, hi, seam))
    return out


def filed(text: Texts, window: int, rounds: int = ROUNDS):
    """Rows for all windows: surroundings, all words, first place, number of windows
    (negative for a run of one word, in which all windows are equal), and 16-bit hashes
    of the words before and behind the surroundings.

    A window that two rows share goes beyond their surroundings by half of what is
    left of it on one side at least; so many words are hashed, and 0 says that the
    text has fewer.
    """
    first = text.starts(window)
    if len(first) == 0:
        return (np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4)))
    names = Ranges(text.names, BASE)
    key, chosen = np.zeros(len(first), U), np.full(len(first), -1)
    low, high = first.copy(), first + window
    rest = np.arange(len(first))
    levels = cuts(text.names, text.inside, rounds)
    for level in range(len(levels) - 1, -1, -1):
        start, lo, hi, seam = levels[level]
        begin = first[rest]
        least = np.searchsorted(lo, begin, "left")
        last = np.searchsorted(hi, begin + window, "right") - 1
        best = np.full(len(rest), -1)
        value = np.full(len(rest), np.iinfo(U).max, U)
        for k in range(window):
            at = least + k
            some = np.flatnonzero(at <= last)
            if len(some) == 0:
                break
            better = some[(seam[at[some]] < value[some]) | (best[some] < 0)]
            best[better], value[better] = at[better], seam[at[better]]
        found = best >= 0
        cut = best[found]
        around = names.name(lo[cut], hi[cut]) + U(level * AGAIN % (1 << 64)) + (start[cut] - lo[cut]).astype(U)
        key[rest[found]] = mix(around)
        chosen[rest[found]] = start[cut] * len(levels) + level
        low[rest[found]], high[rest[found]] = lo[cut], hi[cut]
        rest = rest[~found]
    # what is left are windows of one word only: one row for each run
    head = np.ones(len(first), bool)
    head[1:] = (chosen[1:] != chosen[:-1]) | (first[1:] != first[:-1] + 1)
    head = np.flatnonzero(head)
    count = np.diff(np.append(head, len(first)))
    begin = first[head]
    run = chosen[head] < 0
    words = names.name(begin, begin + np.where(run, window, count + window - 1))
    around = np.where(run, mix(words ^ U(AGAIN)), key[head])
    low, high = low[head], high[head]
    half = (window - (high - low) + 1) // 2
    outside = np.append(0, np.cumsum(~text.inside))

    def side(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.maximum(start, 0), np.minimum(end, len(text.names))
        short = (end - start < half) | (outside[end] > outside[start])
        return np.where(short, 0, (names.name(start, end) >> U(48)).astype(np.int64) | 1)

    before, behind = side(low - half, low), side(high, high + half)
    return around, words, begin, np.where(run, -count, count), before, behind


# -- step 1: rows dealt by their surroundings ---------------------------------------------

#: Kinds of rows: some windows; the same, of frequent surroundings; repeated words;
#: repeated windows. Words are counted in the third, windows in the others.
PLAIN, FREQUENT, SETTLED, REPEATED = range(4)
ROW = {"deal": "long", "name": "long", "id": "long", "first": "int", "count": "int", "sides": "int", "kind": "byte"}
MARK = {"id": "long", "kind": "byte", "first": "int", "count": "int", "name": "long"}
TYPES = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8()}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in columns.items())


def _batch(columns: dict[str, str], values: list[np.ndarray]) -> pa.RecordBatch:
    arrays = []
    for kind, v in zip(columns.values(), values):
        v = v.view(np.int64) if v.dtype == U else v
        arrays.append(pa.array(v.astype(TYPES[kind].to_pandas_dtype(), copy=False)))
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges that are sorted by start, and whose ends are sorted too."""
    if len(start) == 0:
        return start, end
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    head = np.flatnonzero(head)
    return start[head], np.append(end[head[1:] - 1], end[-1])


def _slice_rows(ids: np.ndarray, texts: pa.Array, window: int, frequent: np.ndarray) -> pa.RecordBatch:
    """Rows of a slice. Those a smaller document of the slice has too become ranges."""
    text = Texts(texts)
    around, words, begin, count, before, behind = filed(text, window)
    owner = text.text_of(begin)
    id_ = ids[owner]
    order = np.lexsort((id_, words, around))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(around[order]) != 0) | (np.diff(words[order]) != 0)
    least = id_[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    repeated = np.zeros(len(order), bool)
    repeated[order] = id_[order] > least
    reach = np.abs(count) + window - 1
    start, end = _merged(begin[repeated], (begin + reach)[repeated])
    settled = text.text_of(start)
    hot = np.isin(around, frequent)
    keep = ~repeated
    names = Ranges(text.names, BASE).name(start, end)
    n = len(start)
    return _batch(
        ROW,
        [
            np.append(np.where(hot, mix(around + words), around)[keep], mix(names)),
            np.append(words[keep], names),
            np.append(id_[keep], ids[settled]),
            np.append(text.number(begin, owner)[keep], text.number(start, settled)),
            np.append(count[keep], end - start),
            np.append((before << 16 | behind)[keep].astype(np.uint32).view(np.int32), np.zeros(n, np.int32)),
            np.append(np.where(hot, FREQUENT, PLAIN)[keep], np.full(n, SETTLED)),
        ],
    )


def _rows(docs: DataFrame, window: int, frequent: list[int]) -> DataFrame:
    hot = np.array(frequent, np.int64).view(U)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                ids = part.column("num").to_numpy(zero_copy_only=False)
                yield _slice_rows(ids, batches.as_text(part.column("text")), window, hot)

    return docs.select("num", "text").mapInArrow(run, _ddl(ROW))


def _frequent(docs: DataFrame, window: int) -> list[int]:
    """Surroundings with more than a quarter of a task's share of the sampled rows:
    fewer than four times the number of tasks."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = write_table(_rows(docs.sample(SAMPLE, seed=1), window, []).select("deal"), "sample")
    most = max(16, found.rows // (4 * tasks))
    counted = found.df.groupBy("deal").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most)
    return [r.deal for r in counted.collect()]


def _settle(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Marks of rows that are sorted by deal, name, id: repeated words, and windows that
    may be in other rows of the same surroundings."""
    settled = rows["kind"] == SETTLED
    done = {c: v[settled] for c, v in rows.items()}
    rows = {c: v[~settled] for c, v in rows.items()}
    n = len(rows["deal"])
    new_deal, new_name = np.ones(n, bool), np.ones(n, bool)
    new_deal[1:] = rows["deal"][1:] != rows["deal"][:-1]
    new_name[1:] = new_deal[1:] | (rows["name"][1:] != rows["name"][:-1])
    heads = np.flatnonzero(new_name)
    group, deal = np.cumsum(new_name) - 1, np.cumsum(new_deal) - 1
    least = rows["id"][heads]
    repeated = rows["id"] > least[group]
    # distinct rows: is there one of another document that agrees on a side?
    deal_of = deal[heads]
    sides = rows["sides"][heads].view(np.uint32).astype(np.int64)
    shared = rows["kind"][heads] == FREQUENT
    for side in (sides >> 16, sides & 0xFFFF):
        some = np.flatnonzero(side)
        _, code, size = np.unique(deal_of[some] << 16 | side[some], return_inverse=True, return_counts=True)
        shared[some[size[code] > 1]] = True
    left = shared[group] & ~repeated
    marks = repeated | left
    values = {c: np.append(rows[c][marks], done[c]) for c in ("id", "first", "count", "name")}
    kind = np.append(np.where(repeated, REPEATED, PLAIN)[marks], done["kind"])
    return _batch(MARK, [values["id"], kind, values["first"], values["count"], values["name"]])


def _marks(rows: DataFrame) -> DataFrame:
    order = ["deal", "name", "id", "first"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0, TYPES[kind].to_pandas_dtype()) for c, kind in ROW.items()}
        for batch in parts:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ROW}
            held = {c: np.append(held[c], new[c]) for c in ROW}
            if len(held["deal"]):
                whole = int(np.searchsorted(held["deal"], held["deal"][-1], "left"))
                if whole:
                    yield _settle({c: v[:whole] for c, v in held.items()})
                    held = {c: v[whole:] for c, v in held.items()}
        yield _settle(held)

    return rows.repartition("deal").sortWithinPartitions(*order).mapInArrow(run, _ddl(MARK))


# -- steps 2 and 3: texts and their marks --------------------------------------------------

FIRST = "id long, n_words long, n_removed long, kept string, text string, done array<int>, a array<long>, b array<long>, at array<int>"
RESULT = "id long, n_words long, n_removed long, kept string"


def _kept(w: batches.Words, keep: np.ndarray, texts: bool) -> list[str]:
    """The kept words of each text joined by spaces, or the SHA-256 of that."""
    size = (w.ends - w.starts)[keep]
    begin = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[spread(begin, size)] = w.data[spread(w.starts[keep], size)]
    joined = joined.tobytes()
    bounds = np.append(0, np.cumsum(keep))[w.first]
    places = np.append(begin, len(joined))
    starts, ends = places[bounds[:-1]].tolist(), places[bounds[1:]].tolist()
    parts = (joined[a : max(a, b - 1)] for a, b in zip(starts, ends))
    return [p.decode() if texts else hashlib.sha256(p).hexdigest() for p in parts]


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    change = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _result(w: batches.Words, covered: np.ndarray, texts: bool) -> list[pa.Array]:
    return [pa.array(w.counts), pa.array(batches.sums(covered, w.first)), pa.array(_kept(w, ~covered, texts), pa.string())]


def _lists(offsets: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(values.astype(kind.to_pandas_dtype(), copy=False)))


def _first_pass(part: pa.RecordBatch, window: int, texts: bool) -> pa.RecordBatch:
    """Apply the marks of a slice's texts; texts with windows left go on."""
    text = Texts(batches.as_text(part.column("text")))
    w = text.words
    lists = part.column("marks")
    owner = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    marks = pc.list_flatten(lists)
    kind, first, count, name = (marks.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "first", "count", "name"))
    first, count = first.astype(np.int64), count.astype(np.int64)
    size = np.where(kind == SETTLED, count, np.abs(count) + window - 1)
    # rows that share an id get each other's marks: the words must have the mark's name
    fits = first + size <= w.counts[owner]
    begin = np.where(fits, first + (w.first[:-1] + text.shift)[owner], 0)
    size = np.where(fits, size, 0)
    named = np.where((count < 0) & fits, window, size)
    names = Ranges(text.names, BASE)
    fits &= names.name(begin, begin + named).view(np.int64) == name
    done = fits & (kind != PLAIN)
    start = (first + w.first[:-1][owner])[done]
    covered = _covered(len(w), start, start + size[done])
    left = np.flatnonzero(fits & (kind == PLAIN))
    left = left[np.lexsort((first[left], owner[left]))]
    at = spread(first[left], np.abs(count[left]))
    place = spread(begin[left], np.abs(count[left]))
    more = np.bincount(np.repeat(owner[left], np.abs(count[left])), minlength=part.num_rows)
    offsets = np.append(0, np.cumsum(more))
    other = Ranges(text.names, AGAIN)
    # ranges of covered words of the texts that go on, as numbers of their words
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    border = np.zeros(len(w) + 1, bool)
    border[w.first[:-1][w.counts > 0]] = True
    inside = np.append(covered, False) & np.append(False, covered) & border
    rise, fall = np.flatnonzero((edge > 0) | inside), np.flatnonzero((edge < 0) | inside)
    text_of = np.searchsorted(w.first, rise, "right") - 1
    going = more[text_of] > 0
    rise, fall, text_of = rise[going], fall[going], text_of[going]
    ranges = np.column_stack([rise - w.first[text_of], fall - w.first[text_of]]).ravel()
    held = np.append(0, np.cumsum(2 * np.bincount(text_of, minlength=part.num_rows)))
    number = np.arange(part.num_rows)
    ends, goes_on = pa.array(number, mask=more > 0), pa.array(number, mask=more == 0)
    counts, removed, kept = _result(w, covered, texts)
    return pa.RecordBatch.from_arrays(
        [
            part.column("id"),
            counts,
            removed,
            kept.take(ends),
            part.column("text").take(goes_on),
            _lists(held, ranges, pa.int32()),
            _lists(offsets, names.name(place, place + window).view(np.int64), pa.int64()),
            _lists(offsets, other.name(place, place + window).view(np.int64), pa.int64()),
            _lists(offsets, at, pa.int32()),
        ],
        [c.split()[0] for c in FIRST.split(", ")],
    )


def _last_pass(part: pa.RecordBatch, window: int, texts: bool) -> pa.RecordBatch:
    """Remove the ranges already settled and the windows found in smaller documents."""
    w = batches.words(batches.as_text(part.column("text")))
    starts, ends = [], []
    for column, step in (("done", 2), ("hits", 1)):
        lists = part.column(column)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        values = values + np.repeat(w.first[:-1], sizes)
        starts.append(values[::step])
        ends.append(values[1::2] if step == 2 else values + window)
    covered = _covered(len(w), np.concatenate(starts), np.concatenate(ends))
    return pa.RecordBatch.from_arrays(
        [part.column("id"), *_result(w, covered, texts)], ["id", "n_words", "n_removed", "kept"]
    )


def _each_slice(df: DataFrame, work, schema: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                yield work(part)

    return df.mapInArrow(run, schema)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True
) -> DataFrame:
    """Per row of ``docs``: ``n_words``, ``n_removed`` and ``kept``, the words that stay
    joined by one space (with ``texts=False`` the SHA-256 of that). Runs jobs.

    A word goes if it is in a window of ``window`` words that also starts in a document
    with a smaller id. All windows are judged on the input. ``window`` is 13 or more,
    which a round of cuts that depend on 4 words before and behind needs.
    """
    if window < WINDOW:
        raise ValueError(f"windows have {WINDOW} words at least")
    source = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("num"),
        F.col(text_col).alias("text"),
    )
    marks = write_table(_marks(_rows(source, window, _frequent(source, window))), "marks").df
    per_doc = marks.groupBy(F.col("id").alias("num")).agg(
        F.collect_list(F.struct("kind", "first", "count", "name")).alias("marks")
    )
    marked = source.join(per_doc.hint("merge"), "num", "left").select("id", "text", "marks")
    found = _each_slice(marked, lambda part: _first_pass(part, window, texts), FIRST)
    found = write_table(found.withColumn("row", F.monotonically_increasing_id()), "passed").df
    going = found.where("text IS NOT NULL").withColumn("num", F.coalesce("id", F.lit(NO_ID)))
    windows = going.select("row", "num", F.inline(F.arrays_zip("a", "b", "at")))
    least = windows.groupBy("a", "b").agg(F.min("num").alias("least"), F.max("num").alias("most"))
    # written, so that both sides are shuffled as they are and a hot window can be split
    least = write_table(least.where("least < most").select("a", "b", "least"), "least").df
    hits = windows.join(least.hint("merge"), ["a", "b"]).where("num > least")
    hits = hits.groupBy("row").agg(F.collect_list("at").alias("hits"))
    last = going.join(hits, "row", "left").select("id", "text", "done", "hits")
    last = _each_slice(last, lambda part: _last_pass(part, window, texts), RESULT)
    ended = found.where("text IS NULL").select("id", "n_words", "n_removed", "kept")
    return ended.unionByName(last).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
