"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

The leaves of the tree are the ranks of neighbouring token pairs, every inner node
has the smaller of its children, so the root has the lowest rank and walking down
to the left wherever possible finds the leftmost pair of that rank. A merge changes
three leaves and their paths to the root, until no pair can be merged.

Short pre-tokens, nearly all there are, get trees side by side in one array;
long ones, which may be as long as a text, get a tree each.

Defined results: a NULL text is empty and has no tokens; equal rows give equal
rows; empty tables give empty results; other columns are ignored by
:func:`digests` and kept by :func:`encoded`, whose result column wins over a column
of the same name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm import batches

#: Fixed: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No pair: larger than every rank.
NONE = np.iinfo(np.int32).max
#: Pre-tokens up to this many bytes share arrays.
SHORT = 128
#: Bytes of leaves worked on side by side.
SIDE_BY_SIDE = 1 << 18
#: Distinct pre-tokens whose ids a task remembers; it starts anew beyond.
REMEMBERED = 400_000


def byte_characters() -> dict[str, int]:
    """Character -> byte of the printable alphabet byte-level vocabularies use."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Names(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        added = spec["added_tokens"]
        plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
        if (
            spec["normalizer"]
            or before != before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
            or any(model.get(k) for k in ("dropout", "fuse_unk", "ignore_merges"))
            or any(a != a | plain for a in added)
        ):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        self.pattern = regex.compile(PATTERN)
        self.special = {a["content"]: a["id"] for a in added}
        found = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None

        alphabet, vocabulary = byte_characters(), model["vocab"]
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocabulary.items():
            spelled[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.token_lengths = np.array([len(t) for t in spelled], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocabulary[c]

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = size
        keys = np.array([vocabulary[a] * size + vocabulary[b] for a, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order, NONE).astype(np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self._forget()

    # -- encoding ---------------------------------------------------------------

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        place = np.searchsorted(self.keys, key)
        return np.where(self.keys[place] == key, self.ranks[place], NONE)

    def _side_by_side(self, token: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merge every row of ``token`` (rows x width, a power of two); which stay."""
        rows, width = token.shape[0], token.shape[1] - 1
        column = np.arange(width + 1)
        alive = column < lengths[:, None]
        after = np.where(column + 1 < lengths[:, None], column + 1, width).astype(np.int32)
        before = np.broadcast_to((column - 1).astype(np.int32), after.shape).copy()
        tree = np.full((rows, 2 * width), NONE, np.int32)
        paired = column[:-1] + 1 < lengths[:, None]
        tree[:, width:][paired] = self.rank(token[:, :-1][paired], token[:, 1:][paired])
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        row = np.arange(rows)
        while True:
            row = row[tree[row, 1] < NONE]
            if len(row) == 0:
                return alive
            lowest = tree[row, 1]
            node = np.ones(len(row), np.int64)
            for _ in range(width.bit_length() - 1):
                node *= 2
                node += tree[row, node] > lowest
            here = node - width
            gone = after[row, here]
            right = after[row, gone]
            left = before[row, here]
            new = self.made[lowest]
            token[row, here] = new
            alive[row, gone] = False
            after[row, here] = right
            before[row, right] = here
            at_right = np.where(right < width, self.rank(new, token[row, right]), NONE)
            at_left = np.where(left >= 0, self.rank(token[row, left], new), NONE)
            has_left = left >= 0
            tree[row, width + here] = at_right
            tree[row, width + gone] = NONE
            tree[row[has_left], width + left[has_left]] = at_left[has_left]
            for leaf in (gone, here, np.where(has_left, left, here)):
                node = width + leaf.astype(np.int64)
                for _ in range(width.bit_length() - 1):
                    node >>= 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def _alone(self, token: list[int]) -> list[int]:
        """Merge one long pre-token."""
        n, size, rank_of, made = len(token), self.size, self.rank_of, self.made
        width = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = rank_of.get(token[i] * size + token[i + 1], NONE)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        while (lowest := tree[1]) < NONE:
            node = 1
            while node < width:
                node = 2 * node if tree[2 * node] == lowest else 2 * node + 1
            here = node - width
            gone, left = after[here], before[here]
            right = after[gone]
            token[here] = new = int(made[lowest])
            alive[gone] = False
            after[here] = right
            changes = [(gone, NONE), (here, NONE)]
            if right < n:
                before[right] = here
                changes[1] = (here, rank_of.get(new * size + token[right], NONE))
            if left >= 0:
                changes.append((left, rank_of.get(token[left] * size + new, NONE)))
            for leaf, value in changes:
                node = width + leaf
                tree[node] = value
                while node > 1:
                    node >>= 1
                    value = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == value:
                        break  # nothing above changes through this leaf
                    tree[node] = value
        return [t for t, stays in zip(token, alive) if stays]

    def merge(self, spelled: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct pre-tokens: all ids, and how many each has."""
        data, offsets = batches.raw(spelled)
        lengths = np.diff(offsets)
        ids = self.byte_ids[data]
        counts = lengths.copy()
        stays = np.ones(len(ids), bool)
        longest = 1
        while longest < min(SHORT, lengths.max(initial=0)):
            longest *= 2
            chosen = np.flatnonzero((lengths > longest // 2) & (lengths <= longest))
            for part in np.array_split(chosen, len(chosen) * longest // SIDE_BY_SIDE + 1):
                if len(part) == 0:
                    continue
                size = lengths[part]
                inside = np.arange(longest + 1) < size[:, None]
                token = np.zeros((len(part), longest + 1), np.int64)
                place = spread(offsets[part], size)
                token[inside] = ids[place]
                alive = self._side_by_side(token, size)
                ids[place], stays[place] = token[inside], alive[inside]
                counts[part] = alive.sum(1)
        for k in np.flatnonzero(lengths > SHORT):
            merged = self._alone(ids[offsets[k] : offsets[k + 1]].tolist())
            ids[offsets[k] : offsets[k] + len(merged)] = merged
            stays[offsets[k] + len(merged) : offsets[k + 1]] = False
            counts[k] = len(merged)
        return ids[stays], counts

    def pre_tokens(self, text: str) -> list[str | int]:
        """Pre-tokens of a text in order; special tokens are given by their ids."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str | int] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [self.special[part]] if k % 2 else self.pattern.findall(part)
        return out

    def _learn(self) -> None:
        """Merge the pre-tokens named since the last call."""
        new = list(islice(self.names, len(self.counts), None))
        spelled = np.array([isinstance(w, str) for w in new], bool)
        words = pa.array([w for w in new if isinstance(w, str)], pa.large_string())
        merged, found = self.merge(words)
        special = np.array([w for w in new if not isinstance(w, str)], np.int64)
        counts, starts = np.ones(len(new), np.int64), np.zeros(len(new), np.int64)
        counts[spelled] = found
        starts[spelled] = np.cumsum(found) - found
        starts[~spelled] = len(merged) + np.arange(len(special))
        self.starts = np.append(self.starts, len(self.pool) + starts)
        self.counts = np.append(self.counts, counts)
        self.pool = np.concatenate([self.pool, merged, special])

    def _forget(self) -> None:
        self.names = Names()
        self.pool, self.starts, self.counts = (np.zeros(0, np.int64) for _ in range(3))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 places they begin at."""
        if len(self.names) > REMEMBERED:
            self._forget()
        codes, bounds = [np.zeros(0, np.int64)], [0]
        for text in texts.to_pylist():
            cut = self.pre_tokens(text)
            codes.append(np.fromiter(map(self.names.__getitem__, cut), np.int64, len(cut)))
            bounds.append(bounds[-1] + len(cut))
        self._learn()
        code = np.concatenate(codes)
        lengths = self.counts[code]
        upto = np.zeros(len(code) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        return self.pool[spread(self.starts[code], lengths)], upto[bounds]

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of id sequences; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.token_lengths[ids]
        data = self.token_bytes[spread(self.token_starts[ids], lengths)].tobytes()
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        ends = upto[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _digests(codec: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list, list]:
    ids, bounds = codec.encode(texts)
    raw = ids.astype("<u4").tobytes()
    hashed = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
    decoded = [hashlib.sha256(t.encode()).hexdigest() for t in codec.decode(ids, bounds)]
    return ids, bounds, hashed, decoded


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text: number of ids, hashes of the ids and of the text
    they decode to. ``path`` must be readable on every executor."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in parts:
            for part in batches.slices(batch, "text"):
                _, bounds, hashed, decoded = _digests(codec, batches.as_text(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(bounds)), pa.array(hashed), pa.array(decoded)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, {DIGESTS}").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its ids and the round trip's digests."""
    new = [ids_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    other = [c for c in docs.columns if c != text_col and c not in new]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in parts:
            for part in batches.slices(batch, text_col):
                texts = batches.as_text(part.column(text_col))
                ids, bounds, hashed, decoded = _digests(codec, texts)
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in other),
                        lists,
                        pa.array(np.diff(bounds)),
                        pa.array(hashed),
                        pa.array(decoded),
                    ],
                    [*other, *new],
                )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in other]
    schema = ", ".join([*kinds, f"`{ids_col}` array<int>", DIGESTS])
    return docs.select(*other, text_col).mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts that id arrays stand for; a NULL array gives the empty text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in parts:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            bounds = np.cumsum([0, *map(len, lists)])
            flat = np.array([i for x in lists for i in x], np.int64)
            texts = codec.decode(flat, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    source = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
