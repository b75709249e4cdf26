"""Repeated windows of bytes and words against dictionaries of all windows."""

import hashlib
import random

import numpy as np
import pytest
from llm_tables import as_rows, awkward, empty, texts_of, words

from alarmloom.llm import shared, suffixes, superkmers


def brute_bytes(rows, depth):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for text in data:
        for k in range(len(text) - depth + 1):
            seen[text[k : k + depth]] = seen.get(text[k : k + depth], 0) + 1
    out = []
    for (doc_id, _), text in zip(rows, data):
        hit = np.zeros(len(text), bool)
        for k in range(len(text) - depth + 1):
            if seen[text[k : k + depth]] > 1:
                hit[k : k + depth] = True
        spans = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~hit].tobytes()
        out.append((doc_id, len(text), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def noisy(seed, n=25):
    rng = random.Random(seed)
    signs = ["ab", "aab", "b", "ba" * 20, "x" * 30, "é", "the of and ", "q\n"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("depth,digit,part", [(20, 10, 300), (40, 39, 1 << 20), (50, 1, 97)])
def test_repeated_bytes(spark, monkeypatch, depth, digit, part):
    monkeypatch.setattr(suffixes, "PART_BYTES", part)
    docs = awkward(spark, extra=noisy(depth))
    found = suffixes.deduplicate(docs, depth, digit)
    assert as_rows(found, *BYTES) == brute_bytes(texts_of(docs), depth)


def test_repeated_bytes_with_unique_ids(spark):
    docs = spark.createDataFrame(list(enumerate(noisy(3, 40) + [None])), "doc_id long, text string").repartition(4)
    assert as_rows(suffixes.deduplicate(docs, 25, 12), *BYTES) == brute_bytes(texts_of(docs), 25)


def test_anchors_are_dealt_to_all_buckets(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=30_000)) for _ in range(20)]
    rows = shared.referenced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sizes = [0] * 16
    for r in suffixes._first_digits(rows, 400, 200, 16).collect():
        sizes[r["bucket"]] += len(r["packed"])
    assert max(sizes) < 2 * sum(sizes) / 16


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_windows_of_the_last_pass_travel_by_task(spark, monkeypatch, held):
    """Rows between stages follow tasks, buckets and documents, not documents times buckets."""
    monkeypatch.setattr(suffixes, "HELD_WINDOWS", held, raising=False)
    rng = random.Random(6)
    noise = lambda: "".join(rng.choices("abcdefgh ", k=90))
    common = ["".join(rng.choices("abcdefgh ", k=70)) for _ in range(3)]
    texts = [noise() + common[i % 3] + noise() + common[i % 2] + noise() for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = []
    plain = suffixes.with_ranges
    monkeypatch.setattr(suffixes, "bucket_count", lambda docs: 32)
    monkeypatch.setattr(suffixes, "with_ranges", lambda rows, ranges: made.append(ranges) or plain(rows, ranges))
    found = as_rows(suffixes.deduplicate(docs, 50, 25), *BYTES)
    assert found == brute_bytes(texts_of(docs), 50)
    assert sum(r[2] > 0 for r in found) == 60
    last = [len(r["ranges"]) // 16 for r in made[0].collect()]
    assert len(last) <= 60 * 10 and max(last) < 20


def brute_words(rows, window):
    data = [(d, words(t)) for d, t in rows]
    rank = lambda d: (d is None, d)
    first = {}
    for d, w in data:
        for k in range(len(w) - window + 1):
            own = tuple(w[k : k + window])
            first[own] = min(first.get(own, (True, 1 << 62)), rank(d) if d is not None else (True, 0))
    out = []
    for d, w in data:
        hit = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (rank(d) if d is not None else (True, 0)):
                hit[k : k + window] = [True] * window
        kept = " ".join(x for x, h in zip(w, hit) if not h)
        out.append((d, len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("window,hot", [(13, False), (13, True), (3, True), (1, False)])
def test_repeated_words(spark, monkeypatch, window, hot):
    if hot:  # every minimiser that occurs twice counts as hot
        monkeypatch.setattr(superkmers, "HOT_STRINGS", 2)
        monkeypatch.setattr(superkmers, "HOT_SAMPLE", 1)
    docs = awkward(spark, extra=noisy(window))
    found = superkmers.deduplicate(docs, window)
    assert as_rows(found, *WORDS) == brute_words(texts_of(docs), window)


def test_clashing_columns_and_empty_tables(spark):
    for module, columns in ((suffixes, BYTES), (superkmers, WORDS)):
        plain = as_rows(module.deduplicate(awkward(spark)), *columns)
        assert as_rows(module.deduplicate(awkward(spark, clashing=True)), *columns) == plain
        assert module.deduplicate(empty(spark)).collect() == []
