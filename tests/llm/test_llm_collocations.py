"""Collocations against dictionaries of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_tables import as_rows, awkward, empty, lowered

from alarmloom.llm import collocations


def brute(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 6):
                counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        longest = {}
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i : i + size]] = max(a, longest.get(p[i : i + size], 0))
        rows = []
        for p, a in found.items():
            if 100 * longest.get(p, 0) >= 100 * a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def noisy(seed, n=40):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "日本", "a.b", "x;", "y\tz", "\n", "new york", "new york city", "q\x00", "ÀB", "!", "w\x0bw"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(90))) for _ in range(n)]


@pytest.mark.parametrize("least,hot,fold", [(3, False, 1 << 20), (3, True, 500), (9, True, 1 << 20), (1, True, 200)])
def test_collocations_equal_dictionaries(spark, monkeypatch, least, hot, fold):
    monkeypatch.setattr(collocations, "FOLD_BYTES", fold)
    docs = awkward(spark, extra=noisy(least))
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    if hot:  # about half of all prefixes count as hot, whatever their frequency
        monkeypatch.setattr(collocations, "_member", lambda values, ranked: (values >> np.uint64(40)) % np.uint64(2) == 0)
    expected = brute(rows, least, 40)
    assert as_rows(collocations.mine(docs, least, 40), *COLUMNS) == expected
    assert len(expected) > 20


def test_frequent_phrases_by_broadcast_or_shuffle(spark, monkeypatch):
    docs = awkward(spark, extra=noisy(5))
    expected = brute([(r["lang"], r["text"]) for r in docs.collect()], 4, 2000)
    for parts in (1, 30, 10**9):
        monkeypatch.setattr(collocations, "FREQUENT_PARTS", parts)
        assert as_rows(collocations.mine(docs, 4), *COLUMNS) == expected


def test_hot_prefixes_come_from_the_sample(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLE", 1)
    docs = awkward(spark, extra=["p q r s t u " * 200] * 5)
    expected = brute([(r["lang"], r["text"]) for r in docs.collect()], 50, 2000)
    assert as_rows(collocations.mine(docs, 50), *COLUMNS) == expected


def test_clashing_columns_and_empty_tables(spark):
    plain = as_rows(collocations.mine(awkward(spark), 2), *COLUMNS)
    assert as_rows(collocations.mine(awkward(spark, clashing=True).withColumnRenamed("key", "phrase"), 2), *COLUMNS) == plain
    assert collocations.mine(empty(spark)).collect() == []
    assert collocations.mine(awkward(spark), 10**6).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 0, "", 4 * big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)]
    counts = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    found = collocations.scored(counts).collect()
    assert [(r["a"], r["score"]) for r in found] == [(big - 7, 1000 * (big - 7) * 4 * big // (big * (big - 1)))]


def test_three_way_partitions():
    rng = np.random.default_rng(3)
    columns = rng.integers(0, 4, (5, 3000)).astype(np.int32)
    for k in range(1, 5):
        columns[k][columns[k - 1] == 0] = 0
    columns[0] += 1
    weights = rng.integers(1, 4, 3000)
    expected = Counter()
    for suffix, weight in zip(columns.T.tolist(), weights.tolist()):
        for k in range(1, 6):
            if suffix[k - 1]:
                expected[tuple(suffix[:k])] += weight
    found = {tuple(columns[:n, at].tolist()): c for at, n, c in collocations.three_way(columns, weights, np.ones(3000, np.int8), 30)}
    assert found == {p: c for p, c in expected.items() if c >= 30}
