"""Pieces are learnt from every word of every training document, long words included."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmloom.llm import lattice, pieces


def test_long_words_have_expected_pieces(monkeypatch):
    entries = pieces.vocabulary()
    model = lattice.Lattice(pieces.Encoder(entries), lattice.prior(entries))
    word = "internationalisation" * 6
    counts = model.expected([word.encode()], np.array([3.0]))
    signs = {e[0]: len(p) for p, e in model.encoder.table.items() if e}
    assert sum(n * signs.get(i, 0) for i, n in enumerate(counts)) == pytest.approx(3 * len(model.encoder.marked(word)))
    short = ["the".encode(), "日本x".encode(), "a\U0001f389b".encode()]
    together = model.expected(short, np.ones(3))
    monkeypatch.setattr(lattice, "MEMO_CHARS", 0)
    assert model.expected(short, np.ones(3)) == pytest.approx(together)


def test_all_training_documents_adapt_the_pieces(spark, monkeypatch):
    """9,000 documents, of which a sample of 4,000 would miss most of the rare ones."""
    monkeypatch.setattr(lattice, "START_ROUNDS", 2)
    rare = ["schnell grün", "日本 été", "x" * 70, "quartz1 zebra2 vivid3"]
    texts = ["the cat of the house"] * 8996 + rare
    rows = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "ref long, text string, train boolean")
    rows = rows.union(spark.createDataFrame([(-1, "unseen held out", False)], rows.schema)).withColumn("text", F.col("text").cast("binary"))
    entries = pieces.vocabulary()
    words = Counter(w.encode() for t in texts for w in t.split())
    weights = lattice.prior(entries)
    for _ in range(2):
        counts = lattice.Lattice(pieces.Encoder(entries), weights).expected(list(words), np.array(list(words.values()), float))
        weights = np.maximum(counts / counts.sum(), lattice.LEAST_WEIGHT)
    assert lattice.adapted(lattice._word_counts(rows.repartition(5)), entries) == pytest.approx(weights / weights.sum(), rel=1e-6)
