"""Repair of conversation structure with one automaton for all conversations.

A row's role and first fault become a symbol, a conversation's symbols its signature.
Signatures are put in order from their ends and dealt to tasks in ranges, so that those
with a common end lie next to each other and share the nodes of that end: a task keeps the
path of one signature and, for the next, makes only the nodes before the common end. A node
knows, for each state of the grammar, the cheapest cost to the end and the edits that begin
it; equal steps between nodes are worked out once. Reading the choices along the path gives
the edits of all conversations with that signature. A signature that very many conversations
have is dealt to several tasks.

The grammar is nothing, or an optional system row and then pairs of user and assistant.
Edits are K (keep, free), R (change the role to the one that fits, 1), D (delete, 2) and
I (insert an empty row of the role that fits, 5); a truncated row that stays costs 5 more;
blank and duplicate rows must go. Of equally cheap edits the ASCII-least are taken.

Rows stay sorted on disk and pass through tasks one after the other, so that of a
conversation only its signature and its edits, a letter for each row, are held whole.

Defined results: NULL role or text is one space; rows of one turn are in order of the MD5
of role and text, NULL turns come first; a NULL id is a conversation of its own; roles count by
their first letter, and one other than s, u, a fits nowhere; repeated rows are duplicates;
empty tables give empty results; other columns are ignored. Texts are looked at whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.session import write_table

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after the system row, after a user, after an assistant.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FIT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Cost of ending in each state, and the edits that end it.
END = (0, 2 * INSERT, INSERT, 0)
END_EDITS = ("", "II", "I", "")
#: Rows of output sent on at a time.
ROWS = 4096

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


# -- automaton ------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _step(costs: tuple[int, ...], symbol: str) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """The node before a node: what its costs have in common, the rest of them, and for
    each state the edits up to and with the row ``symbol`` and the state behind."""
    ways: list[dict[str, tuple[int, int]]] = []
    for q in range(4):
        here = {"D": (DELETE + costs[q], q)}
        if symbol != "x":
            more = TRUNCATED if symbol.isupper() else 0
            here["R"] = (REROLE + more + costs[FIT[q]], FIT[q])
            if (kept := KEEP[q].get(symbol.lower())) is not None:
                here["K"] = (more + costs[kept], kept)
        ways.append(here)
    best = [min(c for c, _ in here.values()) for here in ways]
    for _ in range(3):  # an insertion leads through three states at most
        best = [min(best[q], INSERT + best[FIT[q]]) for q in range(4)]
    hops = []
    for q in range(4):
        edits = ""
        while True:
            fits = {letter: after for letter, (c, after) in ways[q].items() if c == best[q]}
            inserted = best[q] == INSERT + best[FIT[q]]
            letter = min([*fits, "I"] if inserted else fits)
            edits += letter
            if letter != "I":
                break
            q = FIT[q]
        hops.append((edits, fits[letter]))
    least = min(best)
    return least, tuple(c - least for c in best), tuple(hops)


class Path:
    """Nodes of the signature read last, from its end."""

    def __init__(self) -> None:
        self.ends = ""
        self.nodes: list[tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]] = []
        self.made = 0

    def read(self, ends: str) -> tuple[int, str]:
        """Cost and edits of the signature that is ``ends`` read backwards."""
        shared = 0
        for one, two in zip(self.ends, ends):
            if one != two:
                break
            shared += 1
        del self.nodes[shared:]
        total, costs = (self.nodes[-1][0], self.nodes[-1][1]) if shared else (0, END)
        for symbol in ends[shared:]:
            more, costs, hops = _step(costs, symbol)
            total += more
            self.nodes.append((total, costs, hops))
        self.made += len(ends) - shared
        self.ends = ends
        q, edits = 0, []
        for _, _, hops in reversed(self.nodes):
            some, q = hops[q]
            edits.append(some)
        edits.append(END_EDITS[q])
        return total + costs[0], "".join(edits)


# -- rows -----------------------------------------------------------------------------


def damaged(
    docs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows damaged by a hash of id and turn: lost (``lost`` is true), emptied, without
    full stops, repeated, or given to the user."""
    key = F.concat_ws(
        ":", F.coalesce(F.col(id_col).cast("string"), F.lit(" ")), F.coalesce(F.col(turn_col).cast("string"), F.lit(" "))
    )
    harm = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce(F.col(text_col), F.lit(" "))
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(harm == 3, 2).otherwise(1)
    return docs.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.when(harm == 4, "user").otherwise(F.coalesce(F.col(role_col), F.lit(" "))).alias("role"),
        text.alias("text"),
        (harm == 0).alias("lost"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def _kind(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, lost) with their order, kind of role and fault, written."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    said = F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))
    ended = F.regexp_like(text, F.lit(r"[.!?][\x20\x09-\x0D]*+\z"))
    fault = F.when(F.col("lost"), "l").when(~said, "b").when(~ended, "t").otherwise("")
    marked = rows.select(
        "conv",
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        _kind(role).alias("kind"),
        fault.alias("fault"),
        role.alias("role"),
        F.when(F.col("lost"), F.lit(None)).otherwise(text).alias("text"),
    )
    return write_table(marked, "turns").df


def _repeated(marked: DataFrame) -> DataFrame:
    """Light columns of ``marked`` with ``again``: a row of an earlier turn is equal."""
    light = marked.select("conv", "turn", "digest", "kind", "fault")
    spoken = light.where("fault not in ('l', 'b')")
    # NULL turns come first: the smallest struct has them
    first = spoken.groupBy("conv", "digest").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.coalesce("turn", F.lit(-(1 << 63)))).alias("first"),
        F.bool_or(F.col("turn").isNull()).alias("none"),
    )
    first = first.where("rows > 1").select(
        F.col("conv").alias("__conv"), F.col("digest").alias("__digest"), "first", "none"
    )
    # written, so that both sides are shuffled as they are and a hot row can be split
    first = write_table(first, "first").df
    same = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("digest") == F.col("__digest"))
    later = F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("first")))
    joined = light.join(first.hint("merge"), same, "left")
    return joined.select("conv", "turn", "digest", "kind", "fault", F.coalesce(later, F.lit(False)).alias("again"))


class _Signature:
    """Counts and symbols of one conversation, row by row."""

    def __init__(self, conv) -> None:
        self.conv, self.symbols, self.faults = conv, [], {"b": 0, "d": 0, "t": 0}
        self.illegal = self.turns = 0
        self.kind, self.before, self.low, self.turn = "", None, None, None

    def add(self, turn, digest, kind, fault, again) -> None:
        if fault == "l":
            return
        if fault != "b" and (again or self.before == (turn, digest)):
            fault = "d"
        self.before = (turn, digest)
        if fault:
            self.faults[fault] += 1
        if self.kind and self.kind + kind not in ("su", "ua", "au"):
            self.illegal += 1
        self.kind = kind
        if turn is not None and turn != self.turn:
            self.low = turn if self.turns == 0 else self.low
            self.turns, self.turn = self.turns + 1, turn
        self.symbols.append("x" if fault in ("b", "d") else kind.upper() if fault == "t" else kind)

    def row(self) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, "".join(self.symbols))


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of bounded rows and characters."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS or size >= chars:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _schema(rows: DataFrame, more: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = StructType([StructField("conv", rows.schema["conv"].dataType)])
    whole = StructType([*kind.fields, *_parse_datatype_string(more).fields])
    return whole, to_arrow_schema(whole)


def signatures(marked: DataFrame) -> DataFrame:
    """Counts and ``signature`` of each conversation of :func:`_marked`. Runs jobs."""
    schema, arrow = _schema(marked, ", ".join(f"{c} long" for c in COUNTS) + ", signature string")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in parts:
            for conv, *row in _columns(batch):
                if now is None or now.conv != conv:
                    if now is not None:
                        yield now.row()
                    now = _Signature(conv)
                now.add(*row)
        if now is not None:
            yield now.row()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(read(parts), arrow)

    rows = _repeated(marked)
    n = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the lost rows first: they are no part of what is counted
    ordered = rows.repartition(n, "conv").sortWithinPartitions("conv", F.expr("fault <> 'l'"), "turn", "digest")
    return write_table(ordered.mapInArrow(run, schema), "signatures").df


def _judged(marked: DataFrame) -> DataFrame:
    found = signatures(marked)
    schema, arrow = _schema(found, ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        path, last, result = Path(), None, (0, "")
        for batch in parts:
            for *row, ends in _columns(batch):
                if ends != last:
                    last, result = ends, path.read(ends)
                yield (*row, *result)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(read(parts), arrow)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = found.select("conv", *COUNTS, F.reverse("signature").alias("ends"))
    # by the id too, so that one signature may be dealt to several tasks
    dealt = ends.repartitionByRange(n, "ends", "conv").sortWithinPartitions("ends", "conv")
    return write_table(dealt.mapInArrow(run, schema), "audits").df


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv, turn, role, text, lost): the counts of faults,
    the ``cost`` of the cheapest repair and its edits ``audit``. Runs jobs."""
    return _judged(_marked(rows))


# -- repaired rows --------------------------------------------------------------------


def _followed(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From sorted heads and rows of conversations, ``(edit, row)`` after ``("", head)``."""
    head, audit, at, q = None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            at, q = at + 1, FIT[q]
            yield "I", (head["conv"], None, ROLE[q], "")

    for batch in parts:
        names = batch.schema.names
        for values in _columns(batch):
            row = dict(zip(names, values))
            if row["part"] == 0:
                yield from inserted()
                head, audit, at, q = row, row["audit"], 0, 0
                yield "", row
                continue
            yield from inserted()
            edit, role = audit[at], row["role"]
            at += 1
            if edit == "K":
                q = KEEP[q][role[0]]
            elif edit == "R":
                q = FIT[q]
                role = ROLE[q]
            yield edit, (row["conv"], row["turn"], role, row["text"])
    yield from inserted()


def _streamed(rows: DataFrame) -> DataFrame:
    """Heads and rows of all conversations, those of one next to each other and in order."""
    marked = _marked(rows)
    heads = _judged(marked).withColumn("part", F.lit(0))
    texts = marked.where("fault <> 'l'").select("conv", "turn", "digest", "role", "text", F.lit(1).alias("part"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = heads.unionByName(texts, allowMissingColumns=True).repartition(n, "conv")
    return both.sortWithinPartitions("conv", "part", "turn", "digest")


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (conv, turn, role, text, lost) after repair: ``conv, place,
    edit, turn, role, text``, places from 0, deleted rows left out. Runs jobs."""
    stream = _streamed(rows)
    schema, arrow = _schema(stream, "place long, edit string, turn long, role string, text string")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for edit, row in _followed(parts):
            if edit == "":
                place = 0
            elif edit != "D":
                yield (row[0], place, edit, *row[1:])
                place += 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(read(parts), arrow)

    return stream.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv, turn, role, text, lost): counts, cost, edits,
    and the SHA-256 of the repaired rows as lines ``role:text``. Runs jobs."""
    stream = _streamed(rows)
    more = ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
    schema, arrow = _schema(stream, f"{more}, audit string, repaired_sha256 string")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head, summed, first = None, None, True
        for edit, row in _followed(parts):
            if edit == "":
                if head is not None:
                    yield (*head, summed.hexdigest())
                head, summed, first = [row[c] for c in ("conv", *COUNTS, "cost", "audit")], hashlib.sha256(), True
            elif edit != "D":
                line = f"{row[2]}:{row[3]}".encode()
                summed.update(line if first else b"\n" + line)
                first = False
        if head is not None:
            yield (*head, summed.hexdigest())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(read(parts), arrow)

    return stream.mapInArrow(run, schema)
