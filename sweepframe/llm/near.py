"""Near copies by the similarity of their shingle sets.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity
of 0.8 or more, words as in ``simhash``; a group is what such links connect. SimHash finds
the candidates, whole sets decide:

1. Rows that share a band are a bucket. A band is the smallest values of a set under
   ``DEPTH`` hash functions; there are ``BANDS``. At the limit a band is shared with
   probability 0.8 ** 5, so that one pair of 150,000 shares none; more similar pairs are
   lost less often.
2. Within a bucket, fingerprints of ``BITS`` bits are compared bit-sliced, as in
   ``simhash``, and words of 64 texts left as soon as all of them are beyond ``RADIUS``.
   That is six standard deviations more than a pair at the limit differs in, so that one pair
   of a thousand million is lost. Sets of fewer than ``SHORT`` shingles have no meaningful
   angle and are all candidates. A bucket returns a spanning forest of its candidates; what
   the forests connect is a class.
3. Within a class, candidates are found in the same way and compared by their whole sets,
   the closest first. A pair is left out only if links found before already connect it. The
   class returns a spanning forest of the links.

So a pair of texts never becomes a row: a task returns fewer rows than it was given, however many
texts of a bucket or class are alike, or are not. Buckets and classes of more than ``BLOCK``
rows or ``BYTES`` of shingles are dealt by parts, a task for each two parts, so that none is
gathered in one task and every pair still meets. No link is dropped: chains count as they do in
the whole graph.

Defined results: texts without words are equal; texts of fewer words than a shingle are
one shingle; of linked rows the smallest id stays, NULL ids last, then the smallest MD5
of the text; empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm import batches, simhash
from sweepframe.llm.bpe import spread
from sweepframe.llm.components import components
from sweepframe.session import write_table

SHINGLE = 5
BANDS = 30
DEPTH = 5
#: Bits of a fingerprint, and by how many two texts of a similarity of 0.8 differ at most:
#: the angle of such sets is 27.3 degrees, so 155 on average, with a deviation of 11.5.
BITS = 1024
RADIUS = 224
SHORT = 32
#: Rows of a block, and bytes of shingles.
BLOCK = 4096
BYTES = 32 << 20
#: (query, word) pairs compared at a time; shingles looked up at a time.
PAIRS = 1 << 15
LOOKUPS = 1 << 21
#: Rounds in which only the closest pairs of a block are compared; then all that are left.
ROUNDS = 8
#: Shingles hashed at a time.
SHINGLES = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the distinct shingles of each text, one text after the other,
    and the n + 1 places they begin at."""
    import xxhash

    data = batches.raw(texts)[0]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    w = batches.words(texts, data)
    codes, known = w.named()
    names = np.array([xxhash.xxh64_intdigest(x) for x in known], np.uint64)[codes]
    names = np.append(names, np.zeros(SHINGLE, np.uint64))
    count = np.maximum(w.counts - SHINGLE + 1, 1)
    owner = np.repeat(np.arange(len(texts)), count)
    head = spread(w.first[:-1], count)
    size = np.minimum(w.counts, SHINGLE)[owner]
    shingles = size.astype(np.uint64)
    for k in range(SHINGLE):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + np.where(k < size, names[head + k], np.uint64(0))
    shingles = _mixed(shingles)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    return shingles[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def bands(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` names for each set."""
    rng = np.random.default_rng(42)
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    flip = rng.integers(0, 1 << 32, (BANDS, DEPTH), np.uint32)
    times = rng.integers(0, 1 << 31, (BANDS, DEPTH), np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.full((BANDS, DEPTH, n), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), SHINGLES):
        part = short[at : at + SHINGLES]
        own = owner[at : at + SHINGLES]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        for b in range(BANDS):
            for d in range(DEPTH):
                x = (part ^ flip[b, d]) * times[b, d]
                x = np.minimum.reduceat(x ^ (x >> np.uint32(15)), heads)
                least[b, d, own[heads]] = np.minimum(least[b, d, own[heads]], x)
    named = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], n, 1)
    for d in range(DEPTH):
        named = _mixed(named * np.uint64(0x9E3779B97F4A7C15) + least[:, d])
    return named.T


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketches(source: DataFrame) -> DataFrame:
    """``id``, ``digest``, ``n`` (distinct shingles) and ``bands`` per row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                shingles, bounds = shingle_sets(batches.as_text(part.column("text")))
                named = np.ascontiguousarray(bands(shingles, bounds)).ravel()
                lists = _lists(named, np.arange(part.num_rows + 1) * BANDS)
                columns = [part.column("id"), part.column("digest"), pa.array(np.diff(bounds)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n", "bands"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, digest string, n long, bands array<long>")


def fingerprints(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` bits, as 64-bit words, for each set."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    rng = np.random.default_rng(7)
    out = np.zeros((n, BITS // 64), np.uint64)
    for k in range(BITS // 64):
        key = rng.integers(0, 1 << 63, dtype=np.uint64)
        # a hash and its opposite are equally many: ties are broken alike for all sets
        tie = rng.integers(0, 2, 64) * 2 - 1
        ones = np.zeros((n, 64), np.int64)
        for at in range(0, len(shingles), SHINGLES):
            hashes = _mixed(shingles[at : at + SHINGLES] ^ key)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            own = owner[at : at + SHINGLES]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            ones[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        more = 2 * (2 * ones - sizes[:, None]) + tie > 0
        out[:, k] = np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _sets(texts: DataFrame) -> DataFrame:
    """``row``, ``buckets``, ``shingles`` and ``fp`` for ``texts`` (row, buckets, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                shingles, bounds = shingle_sets(batches.as_text(part.column("text")))
                fp = _lists(fingerprints(shingles, bounds).ravel(), np.arange(part.num_rows + 1) * (BITS // 64))
                columns = [part.column("row"), part.column("buckets"), _lists(shingles, bounds), fp]
                yield pa.RecordBatch.from_arrays(columns, ["row", "buckets", "shingles", "fp"])

    return texts.mapInArrow(run, "row long, buckets array<long>, shingles array<long>, fp array<long>")


# -- candidates -----------------------------------------------------------------------


def candidates(fps: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, in bounded parts, that may be near copies by the numbers of their
    shingles and their fingerprints; of blocks of ``sizes``, one after the other."""
    block = np.repeat(np.arange(len(sizes)), sizes)
    long = np.flatnonzero(n >= SHORT)
    kept = np.bincount(block[long], minlength=len(sizes))
    for a, b in simhash.near_pairs(fps[long], kept[kept > 0], RADIUS, PAIRS):
        yield _sized(n, long[a], long[b])
    short = np.flatnonzero(4 * n < 5 * SHORT)
    ends = np.cumsum(np.bincount(block[short], minlength=len(sizes)))[block[short]]
    after = ends - np.arange(len(short)) - 1
    total = np.cumsum(after)
    start = 0
    while start < len(short):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + 64 * PAIRS, "right")))
        place = np.arange(start, stop)
        a, b = np.repeat(place, after[place]), spread(place + 1, after[place])
        yield _sized(n, short[a], short[b])
        start = stop


def _sized(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fit = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
    return a[fit], b[fit]


class Sets:
    """Sets of a block, for the number of shingles that two of them share."""

    def __init__(self, shingles: np.ndarray, bounds: np.ndarray) -> None:
        self.n = np.diff(bounds)
        self.bounds = bounds
        known, self.codes = np.unique(shingles, return_inverse=True)
        self.width = len(known) + 1
        # sets are sorted, so the keys of all are
        self.keys = np.repeat(np.arange(len(self.n)), self.n) * self.width + self.codes

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs have a similarity of 0.8 or more."""
        swap = self.n[a] > self.n[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), bool)
        total = np.cumsum(self.n[a])
        start = 0
        while start < len(a):
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + LOOKUPS, "right")))
            x, y = a[start:stop], b[start:stop]
            pair = np.repeat(np.arange(len(x)), self.n[x])
            key = y[pair] * self.width + self.codes[spread(self.bounds[x], self.n[x])]
            found = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(found, len(self.keys) - 1)] == key
            shared = np.bincount(pair[hit], minlength=len(x))
            # shared / (x + y - shared) >= 4 / 5
            out[start:stop] = 9 * shared >= 4 * (self.n[x] + self.n[y])
            start = stop
        return out


def linked(sets: Sets, fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The smallest place that each place of blocks of ``sizes`` is connected to by links."""
    root = np.arange(len(sets.n))
    for a, b in candidates(fps, sets.n, sizes):
        distance = None
        for turn in range(ROUNDS + 1):
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if len(a) == 0:
                break
            if distance is None:
                order = np.argsort(simhash.distances(fps, a, b), kind="stable")
                a, b, distance = a[order], b[order], True
            chosen = np.ones(len(a), bool)
            if turn < ROUNDS:
                # the closest pair of each group of the two sides
                chosen[:] = False
                for side in (root[a], root[b]):
                    chosen[np.unique(side, return_index=True)[1]] = True
            yes = chosen.nonzero()[0][sets.similar(a[chosen], b[chosen])]
            root = simhash.joined(root, a[yes], b[yes])
            a, b = a[~chosen], b[~chosen]
    return root


# -- blocks ---------------------------------------------------------------------------


def _in_blocks(rows: DataFrame, key: str, most: int, size: str | None = None) -> DataFrame:
    """``rows`` (row and more) with ``key``, collected into ``rows`` of blocks in which any
    two rows with the same key meet. Runs jobs.

    Keys of more than ``most`` rows, or ``BYTES`` of ``size``, are dealt by parts of that size,
    a block for each two parts.
    """
    columns = [c for c in rows.columns if c != key]
    bytes_ = F.sum(size).cast("double") if size else F.lit(0.0)
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(bytes_ / BYTES)).cast("int")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), parts.alias("parts"))
    large = write_table(sizes.where("parts > 1 and rows > 1").select(key, "parts"), "large")
    lone = F.lit(0)
    if not large.rows:
        dealt = rows.withColumns({"p": lone, "q": lone})
    else:
        part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
        dealt = rows.join(large.df.hint("merge"), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("part", part)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # two parts hold each part, too
        dealt = dealt.where("parts = 1 or other <> part")
        dealt = dealt.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    return dealt.groupBy(key, "p", "q").agg(F.collect_list(F.struct(*columns)).alias("rows")).where("size(rows) > 1").select("rows")


def _words(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(-1, BITS // 64)


def _opened(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray]:
    """The rows of all blocks, one block after the other, and the blocks' sizes."""
    column = batch.column(0)
    return pc.list_flatten(column), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _forest(items: pa.StructArray, root: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) from rows to those they are connected to."""
    rows = items.field("row").to_numpy(zero_copy_only=False)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(rows[moved]), pa.array(rows[root[moved]])], ["a", "b"])


def _classes(sets: DataFrame, most: int) -> DataFrame:
    """``row`` and ``root``, the same for all rows that may be linked. Runs jobs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            items, sizes = _opened(batch)
            root = np.arange(len(items))
            n = items.field("n").to_numpy(zero_copy_only=False)
            for a, b in candidates(_words(items.field("fp")), n, sizes):
                apart = root[a] != root[b]
                root = simhash.joined(root, a[apart], b[apart])
            yield _forest(items, root)

    entries = sets.select("row", F.size("shingles").cast("long").alias("n"), "fp", F.explode("buckets").alias("bucket"))
    links = _in_blocks(entries, "bucket", most).mapInArrow(run, "a long, b long")
    roots = write_table(components(links), "classes").df
    # a root is a row of its class
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "row")


def _links(sets: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Links (a, b) that connect all rows connected by a similarity of 0.8. Runs jobs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            items, sizes = _opened(batch)
            lists = items.field("shingles")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            bounds = np.append(0, np.cumsum(n, dtype=np.int64))
            shingles = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64)
            yield _forest(items, linked(Sets(shingles, bounds), _words(items.field("fp")), sizes))

    rows = sets.join(classes.hint("merge"), "row").select("root", "row", "shingles", "fp")
    rows = write_table(rows, "members").df
    rows = rows.withColumn("bytes", 8 * F.size("shingles").cast("long"))
    blocks = _in_blocks(rows, "root", most, "bytes")
    return blocks.mapInArrow(run, "a long, b long")


def _shared(members: DataFrame) -> DataFrame:
    """``members`` of buckets that have several."""
    many = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket")
    # written, so that both sides are shuffled as they are and a hot bucket can be split
    return members.join(write_table(many, "many").df.hint("merge"), "bucket", "left_semi")


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are. Runs jobs.

    Of all rows that are connected by near copies the smallest stays. Rows are told apart
    by id and text; rows equal in both stay or go together. ``most`` is the number of rows
    of a block.
    """
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    rows = write_table(_sketches(source), "sketches").df.dropDuplicates(["id", "digest"])
    # numbers in order of the rows, so that the smallest of linked ones has the smallest
    rows = write_table(rows, "distinct").df.orderBy(F.col("id").isNull(), "id", "digest")
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "rows").df
    members = _shared(rows.select("row", F.explode("bands").alias("bucket")))
    members = write_table(members.groupBy("row").agg(F.collect_list("bucket").alias("buckets")), "members").df
    named = rows.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "row")
    some = named.join(members.hint("merge"), "row")
    same = F.col("id").eqNullSafe(F.col("__id")) & F.col("digest").eqNullSafe(F.col("__digest"))
    texts = source.join(some.hint("merge"), same).select("row", "buckets", "text")
    sets = write_table(_sets(texts.dropDuplicates(["row"])), "sets").df
    gone = components(_links(sets, _classes(sets, most), most)).select(F.col("node").alias("row"))
    stay = named.join(gone.hint("merge"), "row", "left_anti").select("__id", "__digest")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.md5(text).eqNullSafe(F.col("__digest"))
    return docs.join(stay.hint("merge"), same, "left_semi")
