"""Token counts of a piece model with a shortcut for whole tokens.

Pieces of such a model never hold a space after another character, so no merge
crosses the place where a space follows something else. A text therefore falls
into pre-tokens (spaces and what follows them) that are encoded independently.
:func:`prove` checks that property of a vocabulary, from its pieces and the settings
that the model file has for what happens to texts first, and finds the vocabulary
strings that, alone, are encoded as one token. That is done once, before any text is
read; tasks get the strings. Pre-tokens among them count one; only the distinct others
are merged.

Defined results: a NULL text is empty and has no tokens; equal rows give equal
rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm import batches

SPACE_MARK = "▁"
#: Pre-tokens whose counts a task remembers; it starts anew beyond.
REMEMBERED = 500_000


def load(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def _settings(model):
    """What the model does to a text before it encodes it."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    return proto.normalizer_spec


def prove(model) -> set[bytes]:
    """Strings that, after a space, are one token each.

    Fails for vocabularies this operator would count wrongly: those with a piece
    in which a space follows another character, without the piece for one space,
    or that change texts before encoding them.
    """
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
        raise ValueError("a piece of the vocabulary crosses a space")
    if model.encode("") or model.piece_to_id(SPACE_MARK) == model.unk_id():
        raise ValueError("the vocabulary needs a piece for one space")
    settings = _settings(model)
    changes = settings.precompiled_charsmap or settings.normalization_rule_tsv
    if changes or settings.remove_extra_whitespaces or not settings.escape_whitespaces:
        raise ValueError("the model changes texts before it encodes them")
    if not settings.add_dummy_prefix:
        raise ValueError("the model puts no space before a text")
    bodies = [p[1:] for p in pieces if p.startswith(SPACE_MARK) and p.strip(SPACE_MARK)]
    ids = model.encode(bodies, num_threads=1)
    return {b.encode() for b, found in zip(bodies, ids) if len(found) == 1}


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What follows the first space of each pre-token, and where each text's begin.

    The first pre-token of a text has its space from the model, not the text.
    """
    data, offsets = batches.raw(texts)
    if len(data) == 0:
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    space = data == 0x20
    begin = np.zeros(len(data), bool)
    begin[1:] = space[1:] & ~space[:-1]
    # a space after a literal space mark goes on with the same run of spaces
    after = np.flatnonzero(begin)
    after = after[after >= 3]
    mark = (data[after - 1] == 0x81) & (data[after - 2] == 0x96) & (data[after - 3] == 0xE2)
    begin[after[mark]] = False
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    own = np.ones(len(starts), np.int64)
    own[np.searchsorted(starts, heads)] = 0
    return batches.pieces(data, starts + own, ends), np.searchsorted(starts, offsets)


class Counter:
    """Counts tokens of text arrays with one model."""

    def __init__(self, path: str, whole: list[bytes] | None = None) -> None:
        self.model = load(path)
        self.whole = pa.array(sorted(prove(self.model)) if whole is None else whole, pa.large_binary())
        self.known: dict[bytes, int] = {}

    def merged(self, bodies: list[bytes]) -> list[int]:
        fresh = [b for b in bodies if b not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = bodies
        found = self.model.encode([b.decode() for b in fresh], num_threads=1)
        # nothing after the space: the token of the space itself
        self.known.update((b, len(ids) if b else 1) for b, ids in zip(fresh, found))
        return [self.known[b] for b in bodies]

    def count(self, texts: pa.Array) -> np.ndarray:
        bodies, first = pre_tokens(texts)
        coded = bodies.dictionary_encode()
        distinct = coded.dictionary
        cost = np.ones(len(distinct), np.int64)
        rest = ~pc.is_in(distinct, value_set=self.whole).to_numpy(zero_copy_only=False)
        cost[rest] = self.merged(distinct.filter(pa.array(rest)).to_pylist())
        return batches.sums(cost[coded.indices.to_numpy(zero_copy_only=False)], first)


def counted(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` per row of ``docs``.

    ``model_path`` must be readable on the driver and on every executor.
    """
    # tens of thousands of short strings at most: the size of the vocabulary
    whole = sorted(prove(load(model_path)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path, whole)
        for batch in parts:
            for part in batches.slices(batch, "text"):
                texts = batches.as_text(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(counter.count(texts), pa.int64()),
                    ],
                    ["id", "n_bytes", "n_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return found.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
