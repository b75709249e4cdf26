"""Windows of a benchmark against a search of every window, and the index against plain search."""

import hashlib
import re

import numpy as np
import pytest
from llm_tables import as_rows, awkward, empty, lowered, texts_of

from alarmloom.llm import decontaminate
from alarmloom.llm.fmindex import FmIndex

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(rows, items, window):
    windows = {}
    for item, text in items:
        w = item_words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc_id, text in rows:
        w, hit, found = item_words(text), set(), set()
        for own, names in windows.items():
            for k in range(len(w) - len(own) + 1):
                if tuple(w[k : k + len(own)]) == own:
                    hit.update(range(k, k + len(own)))
                    found |= {str(n) for n in names if n is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def benchmark(spark, docs):
    long = next(t for d, t in texts_of(docs) if d == 5).split(" ")
    items = [
        (1, " ".join(long[10:30])),
        (10, " ".join(long[20:33]).upper()),
        (2, "one"),
        (3, None),
        (4, ""),
        (None, " ".join(long[50:62])),
        (1, "two, three"),
        (5, "--- ..."),
        (6, "nowhere at all to be found in any of the texts here"),
    ]
    return spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("block", [1, 60, 2 << 20])
def test_hits_equal_a_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", block)
    docs = awkward(spark)
    table, items = benchmark(spark, docs)
    found = decontaminate.find(docs, table)
    assert as_rows(found, *COLUMNS) == brute(texts_of(docs), items, 10)


def test_cleaned_texts_have_no_hit_and_others_stay(spark):
    docs = awkward(spark, clashing=True)
    table, items = benchmark(spark, docs)
    hit = {d for d, _, n, *_ in brute(texts_of(docs), items, 10) if n}
    cleaned = decontaminate.cleaned(docs, table)
    assert cleaned.columns == docs.columns
    before, after = sorted(texts_of(docs), key=repr), texts_of(cleaned)
    assert len(after) == len(before)
    assert sorted([r for r in after if r[0] not in hit], key=repr) == [r for r in before if r[0] not in hit]
    assert cleaned.where("n_chars <> length(text) and text is not null").count() == 0


def test_empty_tables(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, none).where("contaminated").count() == 0
    assert decontaminate.find(empty(spark), benchmark(spark, docs)[0]).collect() == []


def test_index_finds_every_place():
    rng = np.random.default_rng(1)
    for _ in range(40):
        symbols = np.append(rng.integers(0, 4, rng.integers(1, 80)), 0)
        index = FmIndex(symbols)
        for size in (1, 2, 3, 5):
            phrases = rng.integers(1, 6, (15, size))
            for phrase, low, high in zip(phrases, *index.search(phrases)):
                places = [i for i in range(len(symbols) - size + 1) if (symbols[i : i + size] == phrase).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == places
