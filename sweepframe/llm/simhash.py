"""Near duplicates by SimHash with bit-sliced comparison.

Distinct fingerprints are dealt into blocks: of four bands of 16 bits, two
fingerprints at most two bits apart agree in two at least, so six pairs of bands find
every link. A block that is too large is cut by thirds of its remaining bits, one of
which two linked fingerprints share, again and again; all bits fixed, a block holds one
fingerprint. Within a block, 64 fingerprints stand side by side in each word
of 64 vertical bit planes; carry-save counters add up the differing bits of all lanes
of a word at once, and words whose lanes all exceed the radius are left early. Blocks
return a spanning forest of their links, from which the components follow.

Defined results: a text without words (NULL, empty, spaces) has fingerprint zero and is
linked like any other; equal texts, and rows that share the id, are linked by their
equal fingerprints; the component is named by its smallest id, NULL ids do not count;
empty tables give empty results; other columns are ignored by :func:`groups` and kept
by :func:`representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm import batches
from sweepframe.llm.bpe import spread
from sweepframe.llm.components import components
from sweepframe.session import write_table

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints a block may hold; larger ones are cut.
BLOCK = 4096
#: Shingles hashed at a time.
SHINGLES = 1 << 17
#: (query, word) pairs compared at a time.
PAIRS = 1 << 19
ALL = (1 << 64) - 1


# -- fingerprints -----------------------------------------------------------------


def fingerprint_array(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned fingerprint per text."""
    import xxhash

    data = batches.raw(texts)[0]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    w = batches.words(texts, data)
    size = w.ends - w.starts
    begin = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[spread(begin, size)] = data[spread(w.starts, size)]
    # the last word of each shingle; texts with fewer words have one shingle
    shingles = np.where(w.counts == 0, 0, np.maximum(w.counts - shingle + 1, 1))
    head = spread(w.first[:-1], shingles)
    owner = np.repeat(np.arange(len(texts)), shingles)
    last = head + np.minimum(w.counts, shingle)[owner] - 1
    text, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    starts, ends = begin[head], (begin + size)[last]
    ones = np.zeros((len(texts), 64), np.int64)
    for at in range(0, len(head), SHINGLES):
        part = slice(at, at + SHINGLES)
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        heads = np.flatnonzero(np.diff(owner[part], prepend=-1))
        ones[owner[part][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    more = 2 * ones > shingles[:, None]
    return np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest`` (MD5 of the text) and ``fp`` (as a signed number) per row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                fp = fingerprint_array(batches.as_text(part.column("text"))).view(np.int64)
                kept = [part.column("id"), part.column("digest")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], ["id", "digest", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    return source.mapInArrow(run, f"id {kind}, digest string, fp long")


# -- blocks -----------------------------------------------------------------------


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks() -> list[int]:
    bands = [0xFFFF << (16 * k) for k in range(4)]
    return [bands[i] | bands[j] for i in range(4) for j in range(i)]


def finer(mask: int) -> list[int]:
    """The mask together with each third of the bits it leaves open."""
    free = [k for k in range(64) if not mask >> k & 1]
    return [mask | sum(1 << k for k in free[third::3]) for third in range(RADIUS + 1)]


def blocks(fps: DataFrame, most: int = BLOCK) -> DataFrame:
    """``fps``: arrays of at least two and at most ``most`` distinct fingerprints; any
    two that differ in at most two bits share an array. Runs jobs."""
    masks = first_masks()
    pieces = []
    rows = fps.select("fp", F.explode(F.array(*(F.lit(k) for k in range(len(masks))))).alias("k"))
    while True:
        table = F.array(*(F.lit(signed(m)) for m in masks))
        rows = rows.select("fp", "k", F.col("fp").bitwiseAND(table[F.col("k")]).alias("value"))
        sizes = rows.groupBy("k", "value").agg(F.count(F.lit(1)).alias("rows"))
        large = write_table(sizes.where(F.col("rows") > most).select("k", "value"), "large")
        small = rows.join(large.df, ["k", "value"], "left_anti") if large.rows else rows
        pieces.append(
            small.groupBy("k", "value").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
        )
        if not large.rows:
            return reduce(DataFrame.unionByName, pieces)
        # 3 for each mask before; free bits shrink by a third, so this ends
        inner = F.explode(F.sequence(3 * F.col("k"), 3 * F.col("k") + 2))
        rows = rows.join(large.df, ["k", "value"], "left_semi").select("fp", inner.alias("k"))
        rows = write_table(rows, "finer").df
        masks = [m for mask in masks for m in finer(mask)]


# -- bit-sliced comparison -----------------------------------------------------------


def links(
    fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, queries: slice = slice(None)
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``fps`` (blocks of ``sizes``, one after the other) whose
    fingerprints differ in at most ``radius`` bits. Fingerprints may be rows of several
    words. ``queries``: only pairs whose first place is one of these."""
    fps = fps.reshape(len(fps), -1)
    first = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(fps)) - first[block]
    words = (sizes + 63) // 64
    first_word = np.cumsum(words) - words
    word = first_word[block] + lane // 64
    bit = (lane % 64).astype(np.uint64)
    heads = np.flatnonzero(lane % 64 == 0)
    one = np.uint64(1)
    filled = np.add.reduceat(one << bit, heads)
    # a query meets the lanes after it: the rest of its word and the words behind
    count = ((first_word + words)[block] - word)[queries]
    query = np.repeat(np.arange(len(fps))[queries], count)
    other = spread(word[queries], count)
    over = ~filled[other]
    own = np.cumsum(count) - count
    mine = bit[queries]
    over[own] |= (one << mine) | ((one << mine) - one)
    # counters begin so that they overflow with one bit more than the radius
    width = radius.bit_length()
    begin = (1 << width) - 1 - radius
    counters = [np.full(len(query), np.uint64(ALL if begin >> k & 1 else 0)) for k in range(width)]
    planes = 64 * fps.shape[1]
    for p in range(planes):
        mine = fps[:, p // 64] >> np.uint64(p % 64) & one
        plane = np.add.reduceat(mine << bit, heads)
        carry = plane[other] ^ (np.uint64(0) - mine)[query]
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        # a word can be over the radius after so many planes at the earliest
        if p >= radius and p % (planes // 8) == planes // 8 - 1:
            alive = over != np.uint64(ALL)
            query, other, over = query[alive], other[alive], over[alive]
            counters = [c[alive] for c in counters]
            if len(query) == 0:
                break
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(64):
        hit = (~over >> np.uint64(k) & one).astype(bool)
        found.append((query[hit], heads[other[hit]] + k))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_pairs(
    fps: np.ndarray, sizes: np.ndarray, radius: int, pairs: int = PAIRS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`links` in parts of about so many (query, word) pairs; large blocks are cut."""
    cost = np.cumsum(sizes * ((sizes + 63) // 64))
    first = np.cumsum(sizes) - sizes
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + pairs, "right")))
        part = sizes[start:stop]
        rows = int(part.sum())
        step = max(1, pairs // ((rows + 63) // 64)) if len(part) == 1 else rows
        here = fps[first[start] : first[start] + rows]
        for at in range(0, rows, step):
            a, b = links(here, part, radius, slice(at, min(at + step, rows)))
            yield a + first[start], b + first[start]
        start = stop


def distances(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the fingerprints (rows of words) of pairs of places differ."""
    return np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place each place is connected to."""
    return joined(np.arange(n), a, b)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest place each place is connected to) with further links."""
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def block_links(found: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links within each array of ``found``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lists = batch.column("fps")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            fps = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64)
            cost = np.cumsum(sizes * ((sizes + 63) // 64))
            start, done = 0, 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + PAIRS, "right")))
                part = sizes[start:stop]
                here = fps[done : done + part.sum()]
                root = forest(len(here), *links(here, part))
                moved = np.flatnonzero(root != np.arange(len(here)))
                pair = [here[moved].view(np.int64), here[root[moved]].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])
                start, done = stop, done + int(part.sum())

    return found.mapInArrow(run, "a long, b long")


# -- documents ------------------------------------------------------------------------


def _components(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (id, digest, fp) with ``root``, the same for linked fingerprints."""
    distinct = write_table(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")).select("fp"), "fps").df
    roots = components(block_links(blocks(distinct, most)))
    linked = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return linked.withColumn("root", F.coalesce("root", "fp"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """Per row: the fingerprint in hex and the smallest id of its component. Runs jobs."""
    rows = write_table(fingerprints(docs, id_col, text_col), "fingerprints").df
    rows = write_table(_components(rows, most), "rooted").df
    # written, so that both sides are shuffled as they are and a hot root can be split
    smallest = write_table(rows.groupBy("root").agg(F.min("id").alias("component_id")), "smallest").df
    return rows.join(smallest.hint("merge"), "root").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK
) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest id of each component
    (NULL ids last, then by the text's MD5), all columns as they are. Runs jobs.

    Rows are told apart by id and text; rows equal in both stay or go together.
    """
    rows = write_table(fingerprints(docs, id_col, text_col), "fingerprints").df
    first = F.min(F.struct(F.col("id").isNull(), "id", "digest"))
    stay = _components(rows, most).groupBy("root").agg(first.alias("first"))
    stay = stay.select(F.col("first.id").alias("__id"), F.col("first.digest").alias("__digest"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.md5(F.col(text_col)).eqNullSafe(F.col("__digest"))
    return docs.join(stay.hint("merge"), same, "left_semi")
