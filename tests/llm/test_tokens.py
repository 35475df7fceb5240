"""Token counts and BPE against the libraries that own the vocabularies."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sweepframe.llm import batches, bpe, token_counts
from sweepframe.llm.queries import vocabulary
from tests.llm.cases import ODD, frame

SF = "/root/testdata/sf0.001"
PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
PARTS = [
    " ", "  ", "a", "b", "the", "\n", "\t", "'s", "'", "é", "<|endoftext|>", "中", "ﬁ", " ", "　", "\U0001f600",
    ".", "123", "\x1c", "\x00", "\x85", "a" * 150, "ing ", "​", "٣", "𞤀", "½", "▁", "▁▁", "<s>", "</s>", "<0x0A>",
]


def fuzz(n=4000):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]
    return texts + ["", " ", "   ", "x" * 3000, "abcdefgh" * 700, " " * 500, "▁ ", " ▁", "qz" * 129]


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_counts_of_strange_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = fuzz()
    got = token_counts.Counter(PIECES).count(batches.as_text(pa.array([*texts, None])))
    assert got.tolist() == [*map(len, library.encode(texts)), 0]


def test_counts_after_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counter, texts = token_counts.Counter(PIECES), fuzz(300)
    want = [*map(len, counter.model.encode(texts))]
    for part in (texts[:100], texts[100:], texts[:50]):
        got = counter.count(batches.as_text(pa.array(part)))
        assert got.tolist() == [want[texts.index(t)] for t in part]


def test_whole_tokens_are_single_tokens():
    model = token_counts.load(PIECES)
    whole = token_counts.prove(model)
    assert len(whole) > 10000
    assert all(len(model.encode("x " + w.decode())) == len(model.encode("x")) + 1 for w in sorted(whole)[::50])


def test_counts_of_documents(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = ODD + [(r["doc_id"] + 1000, r["text"]) for r in documents]
    got = token_counts.counted(frame(spark, rows), PIECES, limit=100).collect()
    found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got)
    want = [(str(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    assert found == sorted((*w, w[2] > 100) for w in want)


def library_ids(texts):
    library = Tokenizer.from_file(BYTES)
    library.no_truncation()
    library.no_padding()
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)], library


def split(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_ids_of_strange_texts():
    texts = fuzz()
    want, _ = library_ids(texts)
    codec = bpe.Codec(BYTES)
    ids, bounds = codec.encode(batches.as_text(pa.array(texts)))
    assert split(ids, bounds) == want
    assert codec.decode(ids, bounds) == texts


def test_trees_side_by_side_and_alone_agree():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdetnisé ", k=rng.randint(1, 120))) for _ in range(500)})
    codec = bpe.Codec(BYTES)
    ids, counts = codec.merge(pa.array(words, pa.large_string()))
    alone = [codec._alone(codec.byte_ids[list(w.encode())].tolist()) for w in words]
    assert split(ids, np.append(0, np.cumsum(counts))) == alone


def test_ids_after_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    codec, texts = bpe.Codec(BYTES), fuzz(200)
    want, _ = library_ids(texts)
    for part in (slice(0, 60), slice(60, 200), slice(10, 30)):
        ids, bounds = codec.encode(batches.as_text(pa.array(texts[part])))
        assert split(ids, bounds) == want[part]


def test_decoding_any_ids():
    _, library = library_ids([""])
    codec, rng = bpe.Codec(BYTES), np.random.default_rng(0)
    ids = rng.integers(0, 50257, 20000)
    bounds = np.arange(0, 20001, 20)
    want = [library.decode(x, skip_special_tokens=False) for x in split(ids, bounds)]
    assert codec.decode(ids, bounds) == want


def digest_of(ids):
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_round_trip_of_documents(spark, documents):
    rows = ODD + [(r["doc_id"] + 1000, r["text"]) for r in documents]
    want, _ = library_ids([t or "" for _, t in rows])
    want = sorted(
        (str(i), len(ids), digest_of(ids), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), ids in zip(rows, want)
    )
    docs = frame(spark, rows)
    got = bpe.digests(docs, BYTES).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    full = bpe.encoded(docs, BYTES)
    assert {"doc_id", "source", "ids", "n_tokens", "key"} <= set(full.columns) and "text" not in full.columns
    assert sorted((str(r.doc_id), r.n_tokens, digest_of(r.ids), r.decoded_sha256) for r in full.collect()) == want
    back = bpe.decoded(full, BYTES)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)


def test_empty(spark):
    assert token_counts.counted(frame(spark, []), PIECES).collect() == []
    assert bpe.digests(frame(spark, []), BYTES).collect() == []
    assert bpe.encoded(frame(spark, []), BYTES).collect() == []
