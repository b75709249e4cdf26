"""Chunks against whole texts, whole texts against all segmentations, and the exact round trip."""

import hashlib
import random

import numpy as np
import pytest
from llm_tables import as_rows, awkward, empty, texts_of

from alarmloom.llm import pieces


@pytest.fixture(scope="module")
def entries():
    return pieces.vocabulary()


@pytest.fixture(scope="module")
def encoder(entries):
    return pieces.Encoder(entries)


def sample(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        signs = rng.choice(["ab ", "haha!", "the in on\n", "aaaa", "x▁ éb", "abcdefghijklmnop ", "日本\U0001f389 "])
        yield "".join(rng.choice(signs) for _ in range(rng.randrange(1, 150)))


def test_chunks_give_the_pieces_of_the_whole_text(encoder):
    for k, text in enumerate(sample(150, 2)):
        parts = [pieces.Chunk(encoder, *c) for c in pieces.chunks(encoder, text, (1, 2, 7, 16, 40)[k % 5])]
        states = pieces.border_states([p.matrix() for p in parts])
        got = [i for p, a, b in zip(parts, states, states[1:]) for i in p.ids(a, b)]
        assert got == encoder.encode(text).tolist()


def test_matrices_combine_associatively(encoder):
    parts = [pieces.Chunk(encoder, *c).matrix() for c in pieces.chunks(encoder, "hahahahahahahahahahaha" * 3, 16)]
    a, b, c = parts[:3]
    assert pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))


def best_score(encoder, word, held):
    if not word:
        return 0
    if word not in held:
        ways = []
        for k in range(1, min(len(word), encoder.longest) + 1):
            entry = encoder.table.get(word[:k])
            if entry is not None:
                ways.append((entry[1] >> pieces.TIE_BITS) + best_score(encoder, word[k:], held))
        if encoder.table.get(word[:1]) is None:
            byte = (encoder.byte_score >> pieces.TIE_BITS) * len(encoder.fallback(word[0]))
            ways.append(byte + best_score(encoder, word[1:], held))
        held[word] = max(ways)
    return held[word]


def test_pieces_have_the_best_score(encoder, entries):
    for text in sample(60, 4):
        for word in encoder.cut(encoder.marked(text)):
            got = sum(entries[i][1] for i in np.frombuffer(encoder.word(word), np.int32))
            assert got == best_score(encoder, word, {})


@pytest.mark.parametrize("giant,chunk", [(64 << 10, 16 << 10), (100, 37)])
def test_round_trip(spark, monkeypatch, giant, chunk):
    monkeypatch.setattr(pieces, "GIANT_BYTES", giant)
    monkeypatch.setattr(pieces, "CHUNK_CHARS", chunk)
    docs = awkward(spark, extra=list(sample(20, 5)), clashing=True)
    encoded = pieces.encode(docs)
    decoded = pieces.decode(encoded)
    rows = sorted(((d, t or "", hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts_of(docs)), key=repr)
    assert as_rows(decoded, "doc_id", "text", "text_sha256") == rows
    own = pieces.Encoder(pieces.vocabulary())
    lengths = sorted(((d, len(own.encode(t or ""))) for d, t in texts_of(docs)), key=repr)
    assert as_rows(encoded, "doc_id", "n_tokens") == lengths


def test_empty_table(spark):
    assert pieces.decode(pieces.encode(empty(spark))).collect() == []
