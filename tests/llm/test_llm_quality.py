"""Base rules against plain counting, the model against its definition, verdicts against labels."""

import pickle
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from llm_tables import as_rows, awkward, empty, texts_of, words

from alarmloom.llm import quality, shared

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(rows):
    out = []
    for doc_id, text in rows:
        w = words(text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        out.append((doc_id, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed))
    return sorted(out, key=repr)


def test_base_rules(spark):
    extra = ["a b c d e f\n\na b c d e f\r\n a\x0bb|c# <d>", "x y z " * 40, "l1\nl1\nl2\n \nl1"]
    docs = awkward(spark, extra=extra, clashing=True)
    found = quality.judge(docs)
    assert as_rows(found, *BASE) == brute(texts_of(docs))
    assert found.where("base_failed and kept").count() == 0
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert kept.count() == found.where("kept").count()


def test_empty_table(spark):
    assert quality.judge(empty(spark)).collect() == []
    assert quality.filtered(empty(spark)).collect() == []


def spoilt(docs, labels):
    """Clean texts with words shuffled (kind 1), one word in ten foreign (2), or few words over and over (3)."""
    rng = random.Random(5)
    rows = docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").select("text", "lang").collect()
    out = []
    for k, row in enumerate([r for r in rows if len(r["text"].split()) >= 60][:300]):
        w = row["text"].split()
        foreign = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
        if k % 3 == 0:
            rng.shuffle(w)
        elif k % 3 == 1:
            w = [foreign() if rng.random() < 0.1 else x for x in w]
        else:
            w = [x for i in range(60) for x in (*rng.sample(w[:8], 8), w[8 + i % (len(w) - 8)])]
        out.append((10**9 + k, " ".join(w), row["lang"]))
    return out


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    more = spark.createDataFrame(spoilt(docs, labels), "doc_id long, text string, lang string")
    return quality.judge(docs.unionByName(more)).join(labels, "doc_id", "left").toPandas()


def test_clean_documents_stay_and_junk_goes(judged):
    clean = judged[(judged.quality == 1) & ~judged.base_failed]
    junk = judged[judged.quality == 0]
    assert clean.kept.mean() >= 0.975
    assert junk.kept.mean() < 0.3


@pytest.mark.parametrize("kind,most", [(0, 0.15), (1, 0.1), (2, 0.1)])
def test_word_order_foreign_words_and_repetition(judged, kind, most):
    spoilt_ = judged[(judged.doc_id >= 10**9) & (judged.doc_id % 3 == (10**9 + kind) % 3)]
    assert len(spoilt_) == 100
    assert spoilt_.kept.mean() <= most


def test_counts_of_all_words_over_borders(spark):
    texts = ["ab c\n\nabc  \u00e9", "", None, "%%% a|b", "x" * 9]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    expected = Counter()
    for t in texts:
        w = (t or "").encode().split()
        line = b"    " + b" ".join(w) + b" "
        expected.update(int.from_bytes(line[i - 4 : i + 1], "big") for i in range(4, len(line)) if w)
    found = Counter()
    for r in quality.count_grams(docs).collect():
        assert r["lang"] in ("0en", "1en")
        found[r["gram"]] += r["n"]
    assert found == expected


def test_parts_give_the_same_perplexity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = quality.fit(docs), quality.fit(docs, part_entries=20_000)
    assert len(one.parts) == 1 and len(many.parts) > 3
    values = [
        {r["doc_id"]: (r["log10_perplexity"], r["byte_perplexity"]) for r in quality.score(docs, m).collect()} for m in (one, many)
    ]
    assert values[0].keys() == values[1].keys()
    for k, pair in values[0].items():
        assert pair == (None, None) or pair == pytest.approx(values[1][k], abs=1e-9)


def test_the_driver_passes_the_model_on_in_pieces(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = quality.fit(docs)
    context, sizes = type(spark.sparkContext), []
    send = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, x: (sizes.append(len(pickle.dumps(x))), send(self, x))[1])
    monkeypatch.setattr(quality, "PIECE_ENTRIES", 10_000, raising=False)
    model = quality.fit(docs)
    assert len(model.parts) == 1 and len(sizes) > 5 and max(sizes) < 400_000
    for own, other in zip(model.part(0).grams + model.part(0).contexts, whole.part(0).grams + whole.part(0).contexts):
        assert np.array_equal(own[0], other[0]) and np.array_equal(own[1], other[1])


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scorer = quality.Scorer(quality.fit(docs))
    for context in (b"    ", b" the", b"ther", b"e. T", b"zzzz", b"  qx"):
        base = int.from_bytes(context, "big") << 8
        keys = np.array([base | b for b in range(256)], np.uint64)
        for lang in ("0en", "1en"):
            assert (10 ** scorer.logs([(lang, keys)])[0]).sum() == pytest.approx(1.0, abs=1e-3)


def test_a_text_and_its_copies_do_not_vouch_for_themselves(spark):
    text = " ".join(f"zq{k}xv" for k in range(40))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + k, text, "en") for k in range(30)], docs.schema)
    scored = quality.score(docs.unionByName(more), quality.fit(docs.unionByName(more))).where("lang = 'en'")
    high = scored.where(f"doc_id >= {10**9}").agg({"byte_perplexity": "min"}).first()[0]
    rest = scored.where(f"doc_id < {10**9} and n_words >= 10").agg({"byte_perplexity": "avg"}).first()[0]
    assert high > 1.5 * rest


def test_repeated_words_are_looked_up_once(monkeypatch):
    """Words keep their numbers however they are found, and a block asks for each distinct word and n-gram once."""
    words = [b"a", b"ab", b"eightlen", b"ninechars", "Größe".encode(), b"x\xff", b"#", b"12345678", b"123456789"]
    texts = [b" \t".join(words * 50), b"", b"\n\x0b\x0c", b"a  ab\r\n" * 20, b"ab"]
    for more in ([], [b"a\0 a a\0\0 \0 ab\0cdefghijk"]):
        block, vocabulary = quality.Words(texts + more), shared.Vocabulary()
        split = [t.split() for t in texts + more]
        numbers = vocabulary.of_places(block.raw, block.start, block.length)
        assert [vocabulary.words[k] for k in numbers] == [w for ws in split for w in ws]
        assert block.sizes.tolist() == [len(ws) for ws in split]
        assert block.length.tolist() == [len(w) for ws in split for w in ws]
    assert len(quality.Words([b"", b" "]).start) == 0

    asked, grams = [], []
    plain = shared.Vocabulary.of
    monkeypatch.setattr(shared.Vocabulary, "of", lambda self, ws: asked.extend(ws) or plain(self, ws))
    monkeypatch.setattr(quality.Scorer, "logs", lambda self, pairs: [grams.append(k) or np.zeros(len(k)) for _, k in pairs])
    scorer = quality.Scorer(quality.Model(["en"], []))
    scorer.perplexity(["en"], scorer.read([b" ".join([b"a", b"ab", b"12345678"] * 5000)]))
    assert sorted(asked) == [b"12345678", b"a", b"ab"]
    assert [len(k) for k in grams] == [len(set(k.tolist())) for k in grams]


def test_counts_are_made_and_sent_in_pieces(monkeypatch):
    """Neither the n-grams over borders nor a batch grow with what a task holds."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "bc", "def", "ghijkl", "ü", "mnopqrstu"], k=60)).encode() for _ in range(30)]

    def counted():
        counts = quality.Counts()
        for low in range(0, 30, 10):
            counts.add(["x", "y"] * 5, texts[low : low + 10])
        return list(counts.rows())

    def total(rows):
        out = Counter()
        for r in rows:
            for lang, gram, n in zip(*(r.column(i).to_pylist() for i in range(3))):
                out[lang, gram] += n
        return out

    whole, made = counted(), []
    plain = quality._border_grams
    monkeypatch.setattr(quality, "_border_grams", lambda w: made.append(len(w)) or plain(w))
    monkeypatch.setattr(quality, "WINDOWS_BLOCK", 7)
    monkeypatch.setattr(quality, "SENT_ROWS", 50)
    pieces = counted()
    assert max(made) == 7 and max(len(r) for r in pieces) == 50
    assert total(pieces) == total(whole)


def test_a_part_is_put_together_piece_by_piece():
    """Beside the part a worker holds one unpacked piece of it, not all."""
    rng = np.random.default_rng(5)
    kinds = quality.TABLES
    pieces = [[rng.integers(0, 1 << 20, 10_000 + 100 * i).astype(k) for k in kinds] for i in range(20)]

    class Sent:
        def __init__(self, value):
            self.value = value

    model = quality.Model(["en"], [[Sent(shared.pack(*x)) for x in pieces]] * 2)
    tracemalloc.start()
    part = model.part(1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = [np.concatenate(x) for x in zip(*pieces)]
    for k, (hashes, values) in enumerate(x for pair in zip(part.grams, part.contexts) for x in pair):
        assert np.array_equal(hashes, whole[2 * k]) and np.array_equal(values, whole[2 * k + 1])
    assert peak < 1.3 * sum(x.nbytes for x in whole)


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    text = " ".join(f"w{k % 700}" for k in range(4000))
    docs = spark.createDataFrame([(i, f"{i} {text}", "en") for i in range(800)], "doc_id long, text string, lang string")
    plain = quality.blocks
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def checked(batches, **kinds):
        def small():
            for x in batches:
                assert x.nbytes < 6 << 20
                yield x

        yield from plain(small(), **kinds)

    monkeypatch.setattr(quality, "blocks", checked)
    assert quality.judge(docs.coalesce(1)).count() == 800
    quality.filtered(docs.coalesce(1)).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_worker_gives_back_what_it_no_longer_holds():
    def held():
        return sum(int(n) for n in re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))

    pins = []

    def work(batches):
        for x in batches:
            many = [bytearray(60_000) for _ in range(3000)]
            pins.append(bytearray(60_000))
            yield len(many)

    before = held()
    assert list(shared.released(work)([1])) == [3000]
    assert held() < before + 40_000
