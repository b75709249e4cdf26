"""Quality rules: text statistics and the perplexity of a modified Kneser-Ney model.

The n-grams are of bytes and run over the borders of words (any white space is one blank),
so both spelling and the order of words count. Spark counts them over all texts, discounts
are taken from counts of counts, and the probabilities are sent to the tasks as arrays sorted
by hash, in parts of bounded size; Spark sorts and packs them, and the driver holds one piece of
a part at a time. Texts are dealt to two folds by their hash, and each fold is scored by what the
other one taught, so that no text, nor a copy of it, vouches for itself.
Documents whose perplexity per word or per byte lies outside of their language's bands are
rejected; the bands follow the quartiles of all documents that pass the base rules. Per word,
signs stuck to words and foreign words show; per byte, lists of words and a wrong order do.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from alarmloom.llm.shared import (
    BLOCK_BYTES,
    BUCKETS,
    BUCKETS_SQL,
    MEMO_WORDS,
    ODD,
    SPACE,
    Vocabulary,
    batch,
    blocks,
    by_bucket,
    covered,
    mix,
    pack,
    packed_sizes,
    released,
    shingles,
    small_batches,
    unpack,
)
from alarmloom.operators.sizing import cut_lineage

# Bytes in an n-gram; five leave room for the language in 64 bits.
ORDER = 5
# Entries of a part of the model; a task holds one part at a time.
PART_ENTRIES = 8_000_000
# Entries of a piece of a part, which the driver passes on as one broadcast.
PIECE_ENTRIES = 1 << 20
# Bytes of text that are looked up together in each of several parts.
PARTS_BLOCK = 32 << 20
# Windows over borders of words that a task holds before it sends their n-grams.
HELD_WINDOWS = 2_000_000
# Windows whose n-grams are made together, and n-grams that a task sends in one batch.
WINDOWS_BLOCK, SENT_ROWS = 250_000, 1 << 16
# A band reaches from the quartiles outwards by so many interquartile ranges.
REACH = 2.0
# Words of a text at which chance and the differences between texts weigh the same.
EVEN_WORDS = 2000
# Documents a language needs for a band; with fewer, only the base rules judge.
BAND_DOCS = 50
# Steps of the histograms from which quantiles are read, per unit, and how far deviations are told apart.
STEPS, FAR = 2000, 100
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
# The bits of an n-gram of the highest order.
GRAM = np.uint64((1 << (8 * ORDER)) - 1)
# Arrays of a piece: for each order hashes and values of n-grams, then of contexts.
TABLES = [np.uint64, np.float32] * (2 * ORDER)

FEATURES = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
]
FEATURE_SQL = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
)


@dataclass
class Part:
    """Sorted arrays per order: hashes of n-grams with log10 probabilities, of contexts with log10 weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]


def _read(sent: Broadcast) -> bytes:
    """The value of a broadcast, which a worker does not keep."""
    path = getattr(sent, "_path", None)
    return sent.value if path is None else sent.load_from_path(path)


@dataclass
class Model:
    """Languages, and the parts, each as broadcasts of its pieces by range of hashes.

    N-grams of three and more bytes are dealt to the parts by language and the two bytes before
    their last one, so that all shorter n-grams and contexts of a lookup are in its part.
    """

    languages: list[str]
    parts: list[list[Broadcast]]
    held: Part | None = None

    def part(self, k: int) -> Part:
        """One part; only the part of a model with one part stays in memory."""
        if self.held:
            return self.held
        widths = np.array([np.dtype(kind).itemsize for kind in TABLES])
        sizes = np.array([packed_sizes(_read(sent), len(TABLES)) for sent in self.parts[k]]) // widths
        arrays = [np.empty(n, kind) for n, kind in zip(sizes.sum(axis=0), TABLES)]
        starts = np.cumsum(sizes, axis=0) - sizes
        # One piece at a time is unpacked beside the whole.
        for sent, at, count in zip(self.parts[k], starts, sizes):
            for array, low, n, own in zip(arrays, at, count, unpack(_read(sent), *TABLES)):
                array[low : low + n] = own
        tables = list(zip(arrays[::2], arrays[1::2]))
        part = Part(tables[::2], tables[1::2])
        if len(self.parts) == 1:
            self.held = part
        return part


@dataclass
class Band:
    """Median log10 perplexity, and the limits of the deviation from it in units of chance."""

    low: float
    middle: float
    high: float


def _fold(text: Column) -> Column:
    """The fold of a text, 0 or 1; copies share it."""
    return F.pmod(F.xxhash64(text), F.lit(2))


# ---- statistics of a block of texts ----


def _repeats(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> np.ndarray:
    """Words in windows that occur twice or more in their own text, per text."""
    windows = shingles(words, size)
    n_docs = len(bounds) - 1
    if not len(windows):
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    inside = doc[: len(windows)] == doc[size - 1 :]
    at = np.flatnonzero(inside)
    own = mix(windows[at] ^ (doc[at].astype(np.uint64) * ODD))
    order = np.argsort(own)
    ranked = own[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    hit = covered(len(words), starts, starts + size)
    return np.bincount(doc[hit], minlength=n_docs)


class Texts:
    """Words of a block of texts as numbers of a vocabulary, and the base columns."""

    def __init__(self, texts: list[bytes], vocabulary: Vocabulary):
        words = Words(texts)
        self.windows, self.sizes, self.lengths = words.windows(), words.sizes, words.length
        self.numbers = vocabulary.of_places(words.raw, words.start, words.length)
        bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        repeats = _repeats(vocabulary.hashes[self.numbers], bounds)
        rows: list[list] = [[] for _ in FEATURES]
        for text, n, repeated in zip(texts, self.sizes.tolist(), repeats.tolist()):
            chars = len(text.translate(None, SPACE).decode("utf-8", "replace"))
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
            failed = n < LEAST_WORDS or 100 * repeated > 20 * n
            for row, value in zip(rows, (n, chars, symbols, len(lines) - len(set(lines)), repeated, failed)):
                row.append(value)
        self.columns = rows


# ---- counting and estimation ----


class Words:
    """Words of a block of texts in one buffer, each text after ORDER - 1 blanks, each word before one.

    start and length tell the place of each word, sizes the number of words of each text.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.sizes = np.array([len(ws) for ws in split], np.int64)
        self.raw = b"".join([b" " * (ORDER - 1) + b" ".join(ws) + b" " for ws in split if ws])
        blank = np.frombuffer(self.raw, np.uint8) == 32
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.length = edges[::2], edges[1::2] - edges[::2]

    def windows(self) -> np.ndarray:
        """For each word the four bytes before it and its first four with the blank after it; 0 where it is over."""
        raw = np.frombuffer(self.raw.replace(b"\0", b"\1") + bytes(ORDER), np.uint8)
        out = np.zeros(len(self.start), np.uint64)
        for k in range(1 - ORDER, ORDER - 1):
            byte = raw[self.start + k].astype(np.uint64)
            out = out << np.uint64(8) | (np.where(k > self.length, np.uint64(0), byte) if k > 0 else byte)
        return out


def _border_grams(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end in the second half of each window, and the window of each."""
    keys = np.stack([windows >> np.uint64(8 * k) & GRAM for k in range(ORDER - 2, -1, -1)], axis=1)
    at = np.flatnonzero((keys & np.uint64(255)).ravel())
    return keys.ravel()[at], at // (ORDER - 1)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams inside of words, the blank after them included, and the word of each."""
    raw = np.frombuffer(b" ".join(words).replace(b"\0", b"\1") + b" ", np.uint8).astype(np.uint64)
    key = np.zeros(len(raw), np.uint64)
    for k in range(ORDER):
        key[k:] |= raw[: max(0, len(raw) - k)] << np.uint64(8 * k)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    count = np.maximum(lengths - ORDER + 2, 0)
    owner = np.repeat(np.arange(len(words)), count)
    first = np.cumsum(lengths + 1) - lengths - 1 + ORDER - 1
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    return key[at], owner


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), ranked[1:] != ranked[:-1])))
    return ranked[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Counts:
    """Words and border windows of a task with their counts by language."""

    def __init__(self):
        self.vocabulary = Vocabulary()
        self.words: dict[str, np.ndarray] = {}
        self.windows: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, langs: list[str], texts: list[bytes]) -> None:
        for lang in dict.fromkeys(langs):
            words = Words([t for t, own in zip(texts, langs) if own == lang])
            numbers = self.vocabulary.of_places(words.raw, words.start, words.length)
            n = np.bincount(numbers, minlength=len(self.vocabulary.words))
            before = self.words.get(lang, n[:0])
            n[: len(before)] += before
            self.words[lang] = n
            pair = np.unique(words.windows(), return_counts=True)
            self.windows.setdefault(lang, []).append(pair)
            self.held += len(pair[0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for lang, n in self.words.items():
            known = np.flatnonzero(n)
            inner, owner = _grams([self.vocabulary.words[k] for k in known.tolist()])
            grams, total = _added(inner, n[known][owner])
            windows, counts = _added(*(np.concatenate(x) for x in zip(*self.windows.pop(lang))))
            for low in range(0, len(windows), WINDOWS_BLOCK):
                outer, window = _border_grams(windows[low : low + WINDOWS_BLOCK])
                more = _added(outer, counts[low : low + WINDOWS_BLOCK][window])
                grams, total = _added(*(np.concatenate(x) for x in zip((grams, total), more)))
            for low in range(0, len(grams), SENT_ROWS):
                own = grams[low : low + SENT_ROWS].astype(np.int64)
                yield batch(schema, [pa.repeat(lang, len(own)), own, total[low : low + SENT_ROWS]])


def count_grams(docs: DataFrame) -> DataFrame:
    """Occurrences of each n-gram in all words of all texts: lang, gram, n.

    lang is the language behind the number of the fold that these counts are to score.
    """

    def work(batches):
        counts = Counts()
        for part in blocks(batches):
            counts.add(part.column("lang").to_pylist(), part.column("text").to_pylist())
            if len(counts.vocabulary.words) > MEMO_WORDS or counts.held > HELD_WINDOWS:
                yield from counts.rows()
                counts = Counts()
        yield from counts.rows()

    lang = F.concat((1 - _fold(F.col("text"))).cast("string"), F.coalesce("lang", F.lit(""))).alias("lang")
    rows = docs.where("text is not null").select(lang, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(released(work), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _smoothed(grams: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """Interpolated probability p of each n-gram and the weight of its context.

    Discounts D1, D2 and D3+ come from the counts of counts 1 to 4 of the language; where
    those are too few, the usual 0.5, 1 and 1.5 stand in.
    """
    of = lambda k: F.sum(F.when(F.col("n") == k, 1.0).otherwise(0.0))
    per = grams.groupBy("lang").agg(*[of(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    cut = lambda k, up, usual: F.when(
        usable, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(up) / F.col(f"n{k}")))
    ).otherwise(usual)
    cuts = per.select("lang", cut(1, "n2", 0.5).alias("d1"), cut(2, "n3", 1.0).alias("d2"), cut(3, "n4", 1.5).alias("d3"))
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    near = Window.partitionBy("lang", "context")
    rows = (
        grams.join(F.broadcast(cuts), "lang")
        .withColumn("context", F.shiftright("gram", 8))
        .withColumn("taken", taken)
        .withColumn("total", F.sum("n").over(near))
        .withColumn("weight", F.sum("taken").over(near) / F.col("total"))
        .withColumn("own", (F.col("n") - F.col("taken")) / F.col("total"))
    )
    if lower is None:
        p = F.col("own") + F.col("weight") / 256
    else:
        below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        mask = (1 << (8 * (order - 1))) - 1
        rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask))).join(below, ["lang", "suffix"])
        p = F.col("own") + F.col("weight") * F.col("below")
    return rows.select("lang", "gram", "context", "weight", p.alias("p"))


def _dealt(lang: np.ndarray | Column, two: np.ndarray | Column, n_parts: int) -> np.ndarray | Column:
    """The part of n-grams by language number and the two bytes before the last one."""
    return (two * 40503 + lang * 17) % n_parts


def _pieces(entries: DataFrame, n_parts: int, n_pieces: int) -> DataFrame:
    """The tables of all parts by ranges of hashes, one row each: bucket (part * n_pieces + range) and packed."""

    def spread(batches):
        for rows in batches:
            order, code, gram, context = (rows.column(c).to_numpy().astype(np.int64) for c in ("order", "code", "gram", "context"))
            part = _dealt(code, gram >> 8 & 0xFFFF, n_parts)
            out: list[list] = [[], []]
            for kind, (key, value) in enumerate(((gram, "p"), (context, "weight"))):
                hashed = mix((key | code << 8 * ORDER).astype(np.uint64))
                table = (2 * (order - 1) + kind).astype(np.uint8)
                value = np.log10(rows.column(value).to_numpy()).astype(np.float32)
                piece = ((hashed >> np.uint64(32)) * np.uint64(n_pieces) >> np.uint64(32)).astype(np.int64)
                for k in range(n_parts):
                    own = np.flatnonzero((order <= 2) | (part == k))
                    for b, at in by_bucket(k * n_pieces + piece[own]):
                        at = own[at]
                        at = at[np.lexsort((hashed[at], table[at]))]
                        # Many n-grams share their context.
                        at = at[np.append(True, (hashed[at[1:]] != hashed[at[:-1]]) | (table[at[1:]] != table[at[:-1]]))]
                        out[0].append(b)
                        out[1].append(pack(table[at], hashed[at], value[at]))
            yield batch(BUCKETS, out)

    def gather(rows: pa.Table) -> pa.Table:
        parts = zip(*(unpack(x, np.uint8, np.uint64, np.float32) for x in rows.column("packed").to_pylist()))
        table, hashed, value = (np.concatenate(x) for x in parts)
        arrays = []
        for k in range(2 * ORDER):
            own = np.flatnonzero(table == k)
            held, first = np.unique(hashed[own], return_index=True)
            arrays += [held, value[own[first]]]
        return pa.table([rows.column("bucket").slice(0, 1), pa.array([pack(*arrays)], pa.binary())], schema=BUCKETS)

    return entries.mapInArrow(spread, BUCKETS_SQL).groupBy("bucket").applyInArrow(gather, BUCKETS_SQL)


def fit(docs: DataFrame, part_entries: int = PART_ENTRIES) -> Model:
    """The model of every language, learnt from all words of all documents.

    It has as many parts as its entries need. The driver holds one piece of a part at a time.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        counts = cut_lineage(count_grams(docs))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    codes = spark.createDataFrame(list(enumerate(languages)), "code int, lang string")
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << (8 * order)) - 1
        shorter = F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")
        levels.append(levels[-1].select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    below: DataFrame | None = None
    tables = []
    for order, level in enumerate(reversed(levels), start=1):
        below = cut_lineage(_smoothed(level, below, order))
        tables.append(below.withColumn("order", F.lit(order)))
    entries = reduce(DataFrame.unionByName, tables).join(F.broadcast(codes), "lang").drop("lang")
    total = entries.count()
    n_parts = max(1, math.ceil(total / part_entries))
    n_pieces = max(1, math.ceil(total / n_parts / PIECE_ENTRIES))
    sent = {}
    for row in cut_lineage(_pieces(entries, n_parts, n_pieces)).toLocalIterator():
        sent[row["bucket"]] = spark.sparkContext.broadcast(bytes(row["packed"]))
    # Each part has the n-grams of one and two bytes, so none is without a piece.
    parts = [[sent[b] for b in sorted(sent) if b // n_pieces == k] for k in range(n_parts if sent else 0)]
    return Model(languages, parts)


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, values = table
    if not len(held):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return held[at] == keys, values[at]


class Scorer:
    """log10 probabilities of texts; words of a task are looked up once in each language."""

    def __init__(self, model: Model):
        self.model = model
        self.place = {lang: i for i, lang in enumerate(model.languages)}
        self.block = BLOCK_BYTES if len(model.parts) == 1 else PARTS_BLOCK
        self.vocabulary = Vocabulary()
        self.known: dict[str, np.ndarray] = {}

    def read(self, texts: list[bytes]) -> Texts:
        if len(self.vocabulary.words) > MEMO_WORDS:
            self.vocabulary, self.known = Vocabulary(), {}
        return Texts(texts, self.vocabulary)

    def _found(self, part: Part, keys: np.ndarray, code: np.uint64) -> np.ndarray:
        score = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            own = keys[open_] & np.uint64((1 << (8 * order)) - 1)
            hit, p = _find(part.grams[order - 1], mix(own | code))
            score[open_[hit]] += p[hit]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                break
            seen, weight = _find(part.contexts[order - 1], mix((own >> np.uint64(8)) | code))
            score[open_[seen]] += weight[seen]
        # Without any n-gram of order 1, a byte is one of 256.
        score[open_] -= math.log10(256)
        return score

    def logs(self, asked: list[tuple[str, np.ndarray]]) -> list[np.ndarray]:
        """log10 probability of the last byte of n-grams, for each language asked for."""
        out = [np.zeros(len(keys)) for _, keys in asked]
        n_parts = len(self.model.parts)
        for k in range(n_parts):
            part = self.model.part(k)
            for (lang, keys), score in zip(asked, out):
                code = self.place.get(lang, len(self.place))
                two = (keys >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)
                at = np.flatnonzero(_dealt(code, two, n_parts) == k)
                score[at] = self._found(part, keys[at], np.uint64(code << 8 * ORDER))
        return out

    def perplexity(self, langs: list[str], texts: Texts) -> tuple[list[float | None], list[float | None]]:
        """log10 perplexity per word and per byte of each text; none for a text without words.

        langs are the languages behind the number of the text's fold.
        """
        words = self.vocabulary.words
        owner = np.repeat(np.arange(len(langs)), texts.sizes)
        place = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        code = np.array([place[lang] for lang in langs], np.int64)[owner] if len(langs) else owner
        asked, rest = [], []
        for lang, i in place.items():
            at = np.flatnonzero(code == i)
            held = self.known.get(lang, np.empty(0))
            held = np.concatenate((held, np.full(len(words) - len(held), np.nan)))
            self.known[lang] = held
            new = np.unique(texts.numbers[at][np.isnan(held[texts.numbers[at]])])
            inner, word = _grams([words[k] for k in new.tolist()])
            windows, index = np.unique(texts.windows[at], return_inverse=True)
            outer, window = _border_grams(windows)
            # Many windows and words share their n-grams.
            grams, back = np.unique(np.concatenate((inner, outer)), return_inverse=True)
            asked.append((lang, grams))
            rest.append((at, held, new, word, len(windows), index, window, back))
        score = np.zeros(len(owner))
        found = iter(self.logs(asked))
        for at, held, new, word, n_windows, index, window, back in rest:
            logs = next(found)
            held[new] = np.bincount(word, weights=logs[back[: len(word)]], minlength=len(new))
            borders = np.bincount(window, weights=logs[back[len(word) :]], minlength=n_windows)
            score[at] = held[texts.numbers[at]] + borders[index]
        total = np.bincount(owner, weights=score, minlength=len(langs))
        n_bytes = np.bincount(owner, weights=texts.lengths + 1, minlength=len(langs))
        return tuple([-t / n if n else None for t, n in zip(total.tolist(), size.tolist())] for size in (texts.sizes, n_bytes))


MEASURES = ["log10_perplexity", "byte_perplexity"]
SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *FEATURES, *[(m, pa.float64()) for m in MEASURES]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, the base columns and both measures of perplexity (log10), one row per row of docs."""

    def work(batches):
        scorer = Scorer(model)
        for part in blocks(batches, limit=scorer.block):
            texts = scorer.read(part.column("text").to_pylist())
            langs = part.column("lang").to_pylist()
            keys = [f"{fold}{lang}" for fold, lang in zip(part.column("fold").to_pylist(), langs)]
            yield batch(SCORED, [part.column("doc_id"), langs, *texts.columns, *scorer.perplexity(keys, texts)])

    text = F.coalesce("text", F.lit(""))
    columns = ["doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.cast("binary").alias("text"), _fold(text).alias("fold")]
    return docs.select(*columns).mapInArrow(
        released(work), f"doc_id bigint, lang string, {FEATURE_SQL}, log10_perplexity double, byte_perplexity double"
    )


def _deviation(value: Column, n_words: Column, middle: Column) -> Column:
    """Deviation from the median in units that chance gives texts of any length alike."""
    return (value - middle) * F.sqrt(n_words / (1 + n_words / EVEN_WORDS))


def _quantiles(rows: DataFrame, value: Column, shares: list[float]) -> dict[str, list[float]]:
    """Quantiles of a value by language, from an exact histogram; the driver gets languages times steps."""
    step = F.floor(value * STEPS).alias("step")
    own: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("lang", step).agg(F.count("*").alias("n")).collect():
        own.setdefault(r["lang"], []).append((r["step"], r["n"]))
    out = {}
    for lang, pairs in own.items():
        pairs.sort()
        ends = np.cumsum([n for _, n in pairs])
        if ends[-1] >= BAND_DOCS:
            out[lang] = [pairs[int(np.searchsorted(ends, share * ends[-1]))][0] / STEPS for share in shares]
    return out


def bands(scored: DataFrame, reach: float = REACH) -> dict[str, list[Band]]:
    """Bands of both measures by language, of documents that pass the base rules.

    scored has lang, n_words, base_failed and the measures. Languages with fewer than
    BAND_DOCS such documents have none.
    """
    rows = scored.where("not base_failed and log10_perplexity is not null")
    out: dict[str, list[Band]] = {}
    for measure in MEASURES:
        middle = {lang: m for lang, (m,) in _quantiles(rows, F.col(measure), [0.5]).items()}
        if not middle:
            break
        of = F.try_element_at(F.create_map(*[F.lit(x) for pair in middle.items() for x in pair]), F.col("lang"))
        far = _deviation(F.col(measure), F.col("n_words"), of)
        far = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), far))
        for lang, (low, high) in _quantiles(rows.where(of.isNotNull()), far, [0.25, 0.75]).items():
            wide = reach * max(high - low, 2 / STEPS)
            out.setdefault(lang, []).append(Band(low - wide, middle[lang], high + wide))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """Base columns, perplexity and verdict, one row per row of docs.

    Columns: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log10_perplexity (per word), byte_perplexity (log10), kept. A missing text has no words and fails; a missing
    language counts as a language of its own; languages with few documents have no band.
    Rows that repeat others have the same verdict, very long texts are read whole, and a
    perplexity on a limit is inside. Other columns of docs are not looked at.
    """
    model = fit(docs)
    with small_batches(docs.sparkSession):
        scored = cut_lineage(score(docs, model))
    limits = bands(scored)
    names = [f.name for f in scored.schema] + ["kept"]
    return scored.withColumn("kept", _kept(limits, *(F.col(c) for c in ("lang", "n_words", "base_failed", *MEASURES)))).select(*names)


def _kept(limits: dict[str, list[Band]], lang: Column, n_words: Column, base_failed: Column, *measures: Column) -> Column:
    """The verdict as an expression over maps of bands by language."""
    kept = ~base_failed
    for k, value in enumerate(measures if limits else []):
        pairs = [(F.lit(x), F.struct(F.lit(b[k].low), F.lit(b[k].middle), F.lit(b[k].high))) for x, b in limits.items()]
        band = F.try_element_at(F.create_map(*[x for pair in pairs for x in pair]), F.coalesce(lang, F.lit("")))
        far = _deviation(value, n_words, band["col2"])
        kept &= F.coalesce(far.between(band["col1"], band["col3"]), F.lit(True))
    return kept


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns and nothing else.

    Texts are read twice, to count and to score; rows travel with their scores, so that no text
    is shuffled and none is scored again. Nulls, repeated rows and limits as in judge().
    """
    model = fit(docs)
    extra = ["fold", "n_words", "base_failed", *MEASURES]
    while set(extra) & set(docs.columns):
        extra = [f"_{c}" for c in extra]
    fold, size, failed, *measures = extra
    kinds = [LongType(), BooleanType(), DoubleType(), DoubleType()]
    schema = StructType([*docs.schema.fields, *map(StructField, extra[1:], kinds)])

    def work(batches):
        scorer = Scorer(model)
        for part in blocks(batches, limit=scorer.block):
            texts = scorer.read([(t or "").encode() for t in part.column("text").to_pylist()])
            folds, langs = part.column(fold).to_pylist(), part.column("lang").to_pylist()
            found = scorer.perplexity([f"{k}{x or ''}" for k, x in zip(folds, langs)], texts)
            new = [pa.array(texts.columns[0], pa.int64()), pa.array(texts.columns[-1], pa.bool_()), *[pa.array(x, pa.float64()) for x in found]]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], *extra[1:]])

    with small_batches(docs.sparkSession):
        rows = cut_lineage(docs.withColumn(fold, _fold(F.coalesce("text", F.lit("")))).mapInArrow(released(work), schema))
    names = ["n_words", "base_failed", *MEASURES]
    scored = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), *[F.col(a).alias(b) for a, b in zip(extra[1:], names)])
    verdict = _kept(bands(scored), F.col("lang"), F.col(size), F.col(failed), *map(F.col, measures))
    return rows.where(verdict).select(*docs.columns)
