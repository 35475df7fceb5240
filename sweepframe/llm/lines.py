"""Repeated runs of lines, found by winnowing over line hashes.

A run counts if it has ``RUN`` lines, or fewer with ``WORDS`` words together, so that a long
passage is found however its lines are cut and a short stock line is left. Of the lines of
each smallest such window the one with the smallest hash (the rightmost of equal ones) is
selected. Equal windows select the same line, so a run that occurs twice has a selected line
at the same place in both. The selected lines are fingerprints:

1. A row for each selected line and its position. Positions are counted by the line's hash;
   those whose hash occurs once have no equal and are left.
2. Positions whose hash occurs again are extended both ways to the windows that selected
   them, by 128-bit names, and the first place of each name found: the smallest id, and
   within a document the first line.
3. Lines covered by a window that also starts at an earlier place go.

A longer run is the union of its windows, so matches extend as far as they go. Copies and
frequent lines are sums and joins, never pairs or lists.

Lines are what stands between line feeds, unchanged. Those without a word are skipped:
they are not removed and do not end a run. Words are as in ``batches``.

Defined results: a NULL text has no lines; ids are of any type that can be ordered, NULL ids
count as larger than all others, and rows that share an id as one document, so that of
windows at the same line of several such rows none is the earlier; empty tables give empty
results; other columns are ignored.
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

RUN = 3
#: Words that make a window of fewer lines.
WORDS = 25


class Lines:
    """Lines with a word of a slice of texts, and their 128-bit names in halves."""

    def __init__(self, texts: pa.Array) -> None:
        import xxhash

        self.data, self.offsets = batches.raw(texts)
        spoken = np.append(0, np.cumsum(~batches.SPACE[self.data]))
        start, end = batches.tokens(self.data != 10, self.offsets)
        some = spoken[end] > spoken[start]
        self.starts, self.ends = start[some], end[some]
        self.first = np.searchsorted(self.starts, self.offsets)
        coded = batches.pieces(self.data, self.starts, self.ends).dictionary_encode()
        names = [xxhash.xxh3_128_digest(line) for line in coded.dictionary.to_pylist()]
        names = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        self.names = names[coded.indices.to_numpy(zero_copy_only=False)]

    def begins(self, run: int) -> np.ndarray:
        """Lines with which ``run`` neighbouring lines of one text begin."""
        return spread(self.first[:-1], np.maximum(np.diff(self.first) - run + 1, 0))

    def windows(self, run: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """The smallest windows that count, by their number of lines."""
        start, _ = batches.tokens(~batches.SPACE[self.data], self.offsets)
        words = np.append(0, np.cumsum(np.searchsorted(start, self.ends) - np.searchsorted(start, self.starts)))
        for size in range(1, run):
            begin = self.begins(size)
            yield size, begin[words[begin + size] - words[begin] >= least]
        yield run, self.begins(run)


def selected(hashes: np.ndarray, windows: np.ndarray, run: int) -> np.ndarray:
    """The line each window selects: the smallest hash, the rightmost of equal ones."""
    best = windows.copy()
    for k in range(1, run):
        best = np.where(hashes[windows + k] <= hashes[best], windows + k, best)
    return best


def _names_of(names: np.ndarray, begin: np.ndarray, run: int) -> np.ndarray:
    """128-bit names, in halves, of the windows that begin at some lines."""
    import xxhash

    around = np.ascontiguousarray(names[begin[:, None] + np.arange(run)].reshape(len(begin), 2 * run))
    named = b"".join(xxhash.xxh3_128_digest(x) for x in around)
    return np.frombuffer(named, np.int64).reshape(-1, 2)


WINDOW = "struct<at:long,size:long,a:long,b:long>"


def _positions(source: DataFrame, run: int, words: int) -> DataFrame:
    """``id``, ``digest``, ``mark`` (hash of the line) and ``windows`` (number of the first
    line, of lines, name) of every selected line."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                lines = Lines(batches.as_text(part.column("text")))
                found = []
                for size, begin in lines.windows(run, words):
                    chosen = selected(lines.names[:, 0], begin, size)
                    named = _names_of(lines.names, begin, size)
                    found.append(np.column_stack([chosen, begin, np.full(len(begin), size), named]))
                chosen, begin, size, a, b = np.concatenate(found).T
                order = np.argsort(chosen, kind="stable")
                owner = np.searchsorted(lines.first, begin, "right") - 1
                columns = [c[order] for c in (begin - lines.first[owner], size, a, b)]
                items = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["at", "size", "a", "b"])
                line, counts = np.unique(chosen, return_counts=True)
                bounds = np.append(0, np.cumsum(counts)).astype(np.int32)
                of = pa.array(np.searchsorted(lines.first, line, "right") - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(of),
                        part.column("digest").take(of),
                        pa.array(lines.names[line, 0]),
                        pa.ListArray.from_arrays(pa.array(bounds), items),
                    ],
                    ["id", "digest", "mark", "windows"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {kind}, digest string, mark long, windows array<{WINDOW}>")


def _without(part: pa.RecordBatch, texts: bool) -> pa.RecordBatch:
    """Remove the marked windows of a slice's texts."""
    lines = Lines(batches.as_text(part.column("text")))
    lists = part.column("hits")
    owner = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    hits = pc.list_flatten(lists)
    at, size = (hits.field(c).to_numpy(zero_copy_only=False) for c in ("at", "size"))
    gone = np.zeros(len(lines.starts), bool)
    gone[spread(lines.first[:-1][owner] + at, size)] = True
    feeds = np.append(0, np.cumsum(lines.data == 10))
    of = np.repeat(np.arange(part.num_rows), np.diff(lines.first))[gone]
    number = feeds[lines.starts[gone]] - feeds[lines.offsets[of]]
    drops = np.split(number, np.searchsorted(of, np.arange(1, part.num_rows)))
    data, kept = lines.data.tobytes(), []
    for a, b, drop in zip(lines.offsets.tolist(), lines.offsets[1:].tolist(), drops):
        text = data[a:b]
        if len(drop):
            left = text.split(b"\n")
            for k in drop.tolist():
                left[k] = None
            text = b"\n".join(x for x in left if x is not None)
        kept.append(text.decode() if texts else hashlib.sha256(text).hexdigest())
    return pa.RecordBatch.from_arrays(
        [part.column("id"), pa.array(np.diff(lines.first)), pa.array(batches.sums(gone, lines.first)), pa.array(kept, pa.string())],
        ["id", "n_lines", "n_removed", "kept"],
    )


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS,
    texts: bool = True,
) -> DataFrame:
    """Per row of ``docs``: ``n_lines`` (with a word), ``n_removed`` and ``kept``, the
    text without the removed lines (with ``texts=False`` the SHA-256 of that). Runs jobs.

    A line goes if it is in a window of ``run`` lines, or of fewer with ``words`` words, that
    also starts at an earlier place: in a document with a smaller id, or further up in the
    same one.
    """
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    places = write_table(_positions(source, run, words), "positions").df
    often = places.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("mark")
    # sums are written before they are joined, so that a hot line or window can be split
    often = write_table(often, "often").df
    again = places.join(often.hint("merge"), "mark", "left_semi").select("id", "digest", F.inline("windows"))
    again = write_table(again, "again").df
    place = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    first = again.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = write_table(first.where("first < last").select("a", "b", "first"), "first").df
    hits = again.join(first.hint("merge"), ["a", "b"]).where(place > F.col("first"))
    # rows that share id and text have the same windows: by row, not by id
    hits = hits.groupBy("id", "digest").agg(F.collect_set(F.struct("at", "size")).alias("hits"))
    hits = hits.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "hits")
    same = F.col("id").eqNullSafe(F.col("__id")) & F.col("digest").eqNullSafe(F.col("__digest"))
    marked = source.join(hits.hint("merge"), same, "left").select("id", "text", "hits")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                yield _without(part, texts)

    kind = docs.schema[id_col].dataType.simpleString()
    found = marked.mapInArrow(work, f"id {kind}, n_lines long, n_removed long, kept string")
    return found.withColumnRenamed("id", id_col)
