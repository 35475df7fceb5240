"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and a
bit per failed rule. Policies are masks over those bits, so another policy, or the
effect of leaving a rule out, costs no second look at the texts.

Defined results: a NULL text has no words and no lines; equal rows give equal
rows; empty tables give empty ledgers; other columns are ignored by
:func:`ledger` and kept as they are by :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.llm import batches

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Rule name -> whether a document fails it, from its measurements (columns or
#: arrays); the place in this table is its bit.
RULES = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "many_symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: (m["n_dup_lines"] >= 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 25 * m["n_words"],
}
#: Policies by version: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _duplicates(owner: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, name): does it occur again; is there an equal one before."""
    if len(names) == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    _, code, count = np.unique(
        owner * (names.max() + 1) + names, return_inverse=True, return_counts=True
    )
    earlier = np.ones(len(names), bool)
    earlier[np.unique(code, return_index=True)[1]] = False
    return count[code] > 1, earlier


def _repeat_words(w: batches.Words) -> np.ndarray:
    """Words inside windows of 8 words that their text holds at least twice.

    Windows get exact names by naming neighbours three times: words, pairs of
    words, pairs of pairs, pairs of those. Names of different texts may be equal.
    """
    owner = w.owner
    if len(w) < WINDOW:
        return np.zeros(w.texts, np.int64)
    name, _ = w.named()
    for width in (1, 2, 4):
        pairs = name[:-width] * (name.max() + 1) + name[width:]
        name = np.unique(pairs, return_inverse=True)[1]
    start = np.flatnonzero(owner[: len(name)] == owner[WINDOW - 1 :])
    again, _ = _duplicates(owner[start], name[start])
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, start[again], 1)
    np.add.at(change, start[again] + WINDOW, -1)
    return batches.sums(np.cumsum(change[:-1]) > 0, w.first)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of some texts, in one pass over their bytes."""
    w = batches.words(texts)
    data, offsets = w.data, w.offsets
    spoken = ~batches.SPACE[data]
    line_start, line_end = batches.tokens(data != 10, offsets)
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(spoken, out=upto[1:])
    has_word = upto[line_end] > upto[line_start]
    line_start, line_end = line_start[has_word], line_end[has_word]
    first_line = np.searchsorted(line_start, offsets)
    lines = batches.pieces(data, line_start, line_end).dictionary_encode().indices
    line_owner = np.repeat(np.arange(w.texts), np.diff(first_line))
    _, earlier = _duplicates(line_owner, lines.to_numpy(zero_copy_only=False).astype(np.int64))
    return {
        "n_words": w.counts,
        "word_chars": batches.sums(spoken & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": batches.sums(SYMBOLS[data], offsets),
        "n_lines": np.diff(first_line),
        "n_dup_lines": batches.sums(earlier, first_line),
        "n_repeat_words": _repeat_words(w),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements per row of ``docs``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, "text"):
                found = measure(batches.as_text(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                    ["id", *MEASURES],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fail_bits(columns: dict[str, Column] | None = None) -> Column:
    columns = columns or {m: F.col(m) for m in MEASURES}
    bits = [F.when(fails(columns), 1 << k).otherwise(0) for k, fails in enumerate(RULES.values())]
    return reduce(Column.bitwiseOR, bits).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` per row of ``docs``."""
    return measured(docs, id_col, text_col).withColumn("fail_bits", fail_bits())


def judge(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Ledger with ``base_failed`` and ``kept`` under a policy."""
    bits = F.col("fail_bits")
    base, rules = mask(POLICIES["base"]), mask(POLICIES[policy])
    return entries.withColumn("base_failed", bits.bitwiseAND(base) != 0).withColumn(
        "kept", bits.bitwiseAND(base | rules) == 0
    )


def ablations(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those only it rejects.

    One aggregate over the ledger; a rule alone rejects a document exactly if the
    document's failed bits within the policy are that rule's bit.
    """
    chosen = mask(POLICIES[policy])
    inside = F.col("fail_bits").bitwiseAND(chosen)
    rows = entries.agg(
        F.count(F.lit(1)).alias("documents"),
        F.array(
            *(
                F.struct(
                    F.lit(r).alias("rule"),
                    F.count_if(inside.bitwiseAND(mask([r])) != 0).alias("failed"),
                    F.count_if(inside == mask([r])).alias("only_this"),
                )
                for r in POLICIES[policy]
            )
        ).alias("rules"),
    )
    return rows.select("documents", F.inline("rules"))


def with_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its entry of the ledger as a struct column ``__ledger``."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, *(StructField(f"__{m}", LongType()) for m in MEASURES)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, text_col):
                found = measure(batches.as_text(part.column(text_col)))
                columns = [*part.columns, *(pa.array(found[m], pa.int64()) for m in MEASURES)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = docs.mapInArrow(run, schema)
    entry = F.struct(*(F.col(f"__{m}").alias(m) for m in MEASURES))
    columns = {m: F.col(f"__{m}") for m in MEASURES}
    return rows.select(*docs.columns, entry.withField("fail_bits", fail_bits(columns)).alias("__ledger"))


def accepted(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that a policy keeps by their ledger's bits, all columns as they are."""
    rejected = mask(POLICIES["base"]) | mask(POLICIES[policy])
    bits = F.col("__ledger.fail_bits")
    return with_ledger(docs, text_col).where(bits.bitwiseAND(rejected) == 0).select(*docs.columns)
