"""Base scores against plain counting, marginals against all segmentations, held-out gain of training."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_tables import as_rows, awkward, empty, lowered, texts_of, words

from alarmloom.llm import lattice, pieces


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def brute(rows):
    counts, tokens = Counter(), [(d, words(lowered(t)) + [None]) for d, t in rows]
    for d, own in tokens:
        if not held_out(d):
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, own in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((d, held_out(d), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    return sorted(out, key=repr)


def found(frame):
    rows = frame.collect()
    assert all(r["score"] < 0 for r in rows)
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    return sorted(((*(r[c] for c in names), round(r["base_score"], 6)) for r in rows), key=repr)


@pytest.mark.parametrize("least", [1, 8])
def test_base_scores(spark, monkeypatch, least):
    monkeypatch.setattr(lattice, "COMMON_SAMPLE", 1)
    monkeypatch.setattr(lattice, "COMMON_LEAST", least)
    docs = awkward(spark, extra=["the of und x%d" % i for i in range(12)])
    scores = lattice.score(docs)
    assert found(scores) == brute(texts_of(docs))
    assert found(lattice.score(docs.withColumnRenamed("source", "train"))) == brute(texts_of(docs))


def test_empty_table(spark):
    assert lattice.score(empty(spark)).collect() == []


def all_ways(model, word):
    if not word:
        return 1.0
    total, table = 0.0, model.encoder.table
    for k in range(1, min(len(word), model.encoder.longest) + 1):
        if table.get(word[:k]) is not None:
            total += math.exp(model.weights[table[word[:k]][0]]) * all_ways(model, word[k:])
    if table.get(word[:1]) is None:
        total += math.exp(model.fallback(word[0])) * all_ways(model, word[1:])
    return total


@pytest.fixture(scope="module")
def model():
    entries = pieces.vocabulary()
    return lattice.Lattice(pieces.Encoder(entries), lattice.prior(entries))


def test_marginals_sum_all_segmentations(model):
    own = ["the", "theonion", "éa", "日本x", "inging", "a\U0001f389b"]
    values = model.log10([w.encode() for w in own])
    for word, value in zip(own, values):
        assert value == pytest.approx(math.log10(all_ways(model, model.encoder.marked(word))), abs=1e-9)
        assert model._alone(model.encoder.marked(word)) / math.log(10) == pytest.approx(value, abs=1e-9)
    assert np.isfinite(model.log10([b"x" * 5000])).all()


def test_expected_pieces_of_a_word(model):
    word = b"the"
    counts = model.expected([word], np.array([2.0]))
    marked = model.encoder.marked("the")
    each = np.exp(model.weights)
    for piece, (i, _) in ((p, e) for p, e in model.encoder.table.items() if e and p in marked):
        at = marked.index(piece)
        share = each[i] * all_ways(model, marked[:at]) * all_ways(model, marked[at + len(piece) :])
        assert counts[i] == pytest.approx(2 * share / all_ways(model, marked), rel=1e-9)


def test_training_helps_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in lattice.score(docs).collect() if r["held_out"]]
    learnt = sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    entries = pieces.vocabulary()
    plain = lattice.Lattice(pieces.Encoder(entries), lattice.prior(entries))
    own = [w.encode() for d, t in texts_of(docs) if held_out(d) for w in words(lowered(t))]
    assert learnt > plain.log10(own).sum() / len(own) + 1
