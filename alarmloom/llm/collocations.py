"""Phrase collocations by sorting suffix pointers.

Every word starts a suffix of up to five words. A task reads a run of texts, folds equal
suffixes into one with a count, and deals them out by their leading words, so that all
suffixes with the same leading words meet in one bucket. There a multikey three-way
quicksort orders pointers to the suffixes by one word after the other: the sizes of its
equal partitions are the counts of phrases, and partitions below the least count are
abandoned. Leading words that are too frequent for one bucket deal by one word more; they
are counted on their own, from folded pieces. Cuts, scores and the longer phrases that
make a shorter one needless are joins of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from alarmloom.llm.shared import BUCKETS, BUCKETS_SQL, Vocabulary, batch, bucket_count, by_bucket, mix, pack, unpack
from alarmloom.operators.sizing import cut_lineage

MOST_WORDS = 5
LEAST, TOP = 100, 2_000
# Bytes of text that a task folds together.
FOLD_BYTES = 12 << 20
# Documents that tell which leading words are frequent (layout only): one in so many, fewer in large tables.
SAMPLE, SAMPLE_BYTES = 32, 64 << 20
# Leading words above one part in so many of all suffixes deal by one word more; this also bounds their number.
HOT_PARTS = 300_000
# Phrases above one part in so many of all words are looked up by broadcast.
FREQUENT_PARTS = 20_000

# Upper case A-Z to lower case, tab to blank, and every sign that ends a piece to \n.
SIGNS = bytes.maketrans(
    bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9
)
END = b"\n"
COUNTS_SQL = "lang string, words int, phrase string, f bigint"
COUNTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


class Texts:
    """Words of texts of one language, as numbers; 0 stands between pieces."""

    def __init__(self):
        self.vocabulary = Vocabulary()
        self.vocabulary.update({END: 0, b"": 1})
        self.vocabulary.words, self.blank = [END, b""], 1
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.translate(SIGNS).replace(END, b" \n ").split(b" ")
        words.append(END)
        numbers = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
        self.parts.append(numbers[numbers != self.blank])
        self.size += len(text)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffixes in order, a row per word and 0 behind the end of a piece, and how often each occurs."""
        words = np.concatenate(self.parts)
        starts = np.flatnonzero(words)
        padded = np.concatenate((words, np.zeros(MOST_WORDS, np.int32)))
        columns = np.zeros((MOST_WORDS, len(starts)), np.int32)
        columns[0] = words[starts]
        for k in range(1, MOST_WORDS):
            columns[k] = np.where(columns[k - 1] != 0, padded[starts + k], 0)
        return fold(columns, np.ones(len(starts), np.int64), len(self.vocabulary.words))

    def hashes(self) -> np.ndarray:
        self.vocabulary.of([])
        return self.vocabulary.hashes


def fold(columns: np.ndarray, weights: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in lexicographic order, with the sums of their weights."""
    if not columns.shape[1]:
        return columns, weights
    bits = max(1, int(n_words).bit_length())
    per_key = max(1, 63 // bits)
    keys = []
    for k in range(0, len(columns), per_key):
        key = np.zeros(columns.shape[1], np.int64)
        for column in columns[k : k + per_key]:
            key <<= bits
            key |= column
        keys.append(key)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for key in keys:
        ranked = key[order]
        fresh[1:] |= ranked[1:] != ranked[:-1]
    first = np.flatnonzero(fresh)
    return np.ascontiguousarray(columns[:, order[first]]), np.add.reduceat(weights[order], first)


def prefix_hashes(columns: np.ndarray, hashes: np.ndarray, lang: str) -> list[np.ndarray]:
    """Hash of the first 1, 2, ... words of each suffix, in its language."""
    seed = np.full(columns.shape[1], hash_of(lang), np.uint64)
    out = []
    for column in columns:
        seed = mix(seed * np.uint64(0xD6E8FEB86659FD93) + hashes[column])
        out.append(seed)
    return out


def hash_of(lang: str) -> np.uint64:
    value = 1469598103934665603
    for byte in lang.encode():
        value = (value ^ byte) * 1099511628211 & (1 << 64) - 1
    return np.uint64(value)


def routes(columns: np.ndarray, prefixes: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """How many leading words a suffix is dealt by: two, and more while they are hot; 0 where the suffix ends first."""
    route = np.where(columns[1] != 0, 2, 0).astype(np.int8)
    open_ = np.flatnonzero(route)
    for k in range(2, MOST_WORDS):
        open_ = open_[_member(prefixes[k - 1][open_], hot)]
        longer = columns[k][open_] != 0
        route[open_] = np.where(longer, k + 1, 0)
        open_ = open_[longer]
    return route


def _member(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(values), bool)
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def shortened(columns: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered suffixes cut to k words, equal ones folded."""
    fresh = np.ones(columns.shape[1], bool)
    fresh[1:] = (columns[:k, 1:] != columns[:k, :-1]).any(axis=0)
    first = np.flatnonzero(fresh)
    out = np.zeros((MOST_WORDS, len(first)), np.int32)
    out[:k] = columns[:k, first]
    return out, np.add.reduceat(weights, first) if len(first) else weights[:0]


def dealt(texts: Texts, lang: str, hot: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packed suffixes per bucket: those with two words or more, each word alone, and each hot prefix."""
    columns, weights = texts.suffixes()
    if not columns.shape[1]:
        return
    hashes = texts.hashes()
    prefixes = prefix_hashes(columns, hashes, lang)
    route = routes(columns, prefixes, hot)
    pieces = [(columns, weights, route, prefixes)]
    inside = np.ones(len(weights), bool)
    for k in range(1, MOST_WORDS):
        if k > 1:
            # Hot ones whose shorter prefixes are hot too: these no bucket counts as a whole.
            inside = inside & (columns[k - 1] != 0) & _member(prefixes[k - 1], hot)
        if not inside.any():
            break
        cut, sums = shortened(columns[:, inside], weights[inside], k)
        pieces.append((cut, sums, np.full(len(sums), k, np.int8), prefix_hashes(cut[:k], hashes, lang)))
    columns = np.concatenate([p[0] for p in pieces], axis=1)
    weights = np.concatenate([p[1] for p in pieces])
    route = np.concatenate([p[2] for p in pieces])
    target = np.zeros(len(weights), np.uint64)
    at = 0
    for cut, sums, own, named in pieces:
        for k in range(1, MOST_WORDS + 1):
            member = np.flatnonzero(own == k)
            if len(member):
                target[at + member] = named[k - 1][member]
        at += len(sums)
    sent = np.flatnonzero(route)
    words = texts.vocabulary.words
    for bucket, member in by_bucket((target[sent] % np.uint64(n_buckets)).astype(np.int64)):
        part = sent[member]
        held = columns[:, part]
        used = np.unique(held)
        spelled = b"\n".join(words[i] for i in used.tolist() if i)
        numbers = np.searchsorted(used[used > 0], held).astype(np.int32) + (held > 0)
        yield bucket, pack(lang.encode(), spelled, numbers.astype(np.int32), weights[part], route[part])


def _spread(docs: DataFrame, hot: np.ndarray, n_buckets: int) -> DataFrame:
    """Packed suffixes by bucket."""

    def send(held: dict[str, Texts]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            buckets, packed, size = [], [], 0
            for bucket, row in dealt(texts, lang, hot, n_buckets):
                buckets.append(bucket)
                packed.append(row)
                size += len(row)
                if size > 32 << 20:
                    yield batch(BUCKETS, [buckets, packed])
                    buckets, packed, size = [], [], 0
            if buckets:
                yield batch(BUCKETS, [buckets, packed])

    def work(batches):
        held: dict[str, Texts] = {}
        size = 0
        for part in batches:
            for lang, text in zip(part.column("lang"), part.column("text")):
                texts = held.setdefault(lang.as_py(), Texts())
                texts.add(text.as_py())
                size += len(text.as_buffer())
                if size >= FOLD_BYTES:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    return docs.mapInArrow(work, BUCKETS_SQL)


def three_way(columns: np.ndarray, weights: np.ndarray, route: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(suffix, words, count): the frequent phrases that are prefixes of the suffixes.

    Pointers are partitioned around a pivot word into less, equal and more; the equal ones
    go on at the next word. A prefix shorter than its suffixes' route is counted elsewhere.
    """
    open_ = [(np.arange(columns.shape[1]), 0)]
    while open_:
        pointers, depth = open_.pop()
        if weights[pointers].sum() < least:
            continue
        words = columns[depth][pointers]
        n = len(words)
        pivot = np.sort(words[[n // 4, n // 2, 3 * n // 4]])[1] if n > 2 else words[0]
        below, above = words < pivot, words > pivot
        for side in (below, above):
            if side.any():
                open_.append((pointers[side], depth))
        same = pointers if n == 1 else pointers[~(below | above)]
        if pivot == 0:
            continue
        count = int(weights[same][route[same] <= depth + 1].sum())
        if count >= least:
            yield int(same[0]), depth + 1, count
        if depth + 1 < MOST_WORDS:
            open_.append((same, depth + 1))


def _counted(spread: DataFrame, least: int) -> DataFrame:
    """Frequent phrases of each bucket, and the words of each language, as phrase '' of 0 words."""

    def work(table: pa.Table) -> pa.Table:
        groups: dict[bytes, tuple[dict, list]] = {}
        for packed in table.column("packed").to_pylist():
            lang, spelled, numbers, weights, route = unpack(packed, None, None, np.int32, np.int64, np.int8)
            known, parts = groups.setdefault(bytes(lang), ({}, []))
            words = bytes(spelled).split(b"\n")
            names = np.array([0, *(known.setdefault(w, len(known) + 1) for w in words)], np.int32)
            parts.append((names[numbers.reshape(MOST_WORDS, -1)], weights, route))
        out: list[list] = [[], [], [], []]

        def add(*row):
            for column, value in zip(out, row):
                column.append(value)

        for lang, (known, parts) in groups.items():
            name, words = lang.decode("utf-8", "replace"), [b"", *known]
            columns = np.concatenate([p[0] for p in parts], axis=1)
            weights = np.concatenate([p[1] for p in parts])
            route = np.concatenate([p[2] for p in parts])
            parts.clear()
            add(name, 0, "", int(weights[route == 1].sum()))
            for at, n, count in three_way(columns, weights, route, least):
                add(name, n, b" ".join(words[i] for i in columns[:n, at].tolist()).decode("utf-8", "replace"), count)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, COUNTS)], schema=COUNTS)

    return spread.groupBy("bucket").applyInArrow(work, COUNTS_SQL)


def hot_prefixes(rows: DataFrame, n_buckets: int, n_bytes: int) -> np.ndarray:
    """Hashes of frequent leading words, from a sample of documents; decides the layout and no count."""
    every = max(SAMPLE, n_bytes // SAMPLE_BYTES)
    parts = min(4 * n_buckets, HOT_PARTS)

    def work(batches):
        held: dict[str, Texts] = {}
        for part in batches:
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                held.setdefault(lang, Texts()).add(text)
        names, counts = [], []
        for lang, texts in held.items():
            columns, weights = texts.suffixes()
            if not len(weights):
                continue
            for k in range(2, MOST_WORDS):
                cut, sums = shortened(columns[:, columns[k - 1] != 0], weights[columns[k - 1] != 0], k)
                names.append(prefix_hashes(cut[:k], texts.hashes(), lang)[k - 1].view(np.int64))
                counts.append(sums)
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(names)), pa.array(np.concatenate(counts))], names=["name", "n"]
            )

    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("lang", "text")
    sums = cut_lineage(sample.mapInArrow(work, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n")))
    total = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
    # At most `parts` prefixes of each of three lengths can be that frequent.
    found = sums.where((F.col("n") * parts > F.lit(total)) & (F.col("n") > 20)).select("name").toArrow()
    return np.sort(found.column("name").to_numpy().astype(np.int64).view(np.uint64))


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f: phrases of up to five words with f >= least; and per language one row of 0 words with all its words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("id"), lang.alias("lang"), text.alias("text"))
    n_buckets = bucket_count(docs)
    n_bytes = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    hot = hot_prefixes(rows, n_buckets, n_bytes)
    return _counted(_spread(rows.select("lang", "text"), hot, n_buckets), least)


def _looked_up(cuts: DataFrame, counts: DataFrame, total: int, phrase: str, out: str) -> DataFrame:
    """cuts with the count of the phrase in a column; frequent phrases come by broadcast, so no join key is hot."""
    facts = counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(out))
    # Each length has at most FREQUENT_PARTS phrases this frequent.
    frequent = F.col(out) * FREQUENT_PARTS > F.lit(total)
    near = cuts.join(F.broadcast(facts.where(frequent)), ["lang", phrase], "left")
    rest = near.where(F.col(out).isNull()).drop(out).join(facts.where(~frequent), ["lang", phrase])
    return near.where(F.col(out).isNotNull()).unionByName(rest)


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more that no longer one makes needless.

    counts is read several times: a written table.
    """
    languages = counts.where("words = 0").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    total = languages.agg(F.sum("f").alias("n")).first()["n"] or 0
    whole = counts.where("words > 0")
    parts = F.split("phrase", " ", -1)
    cuts = (
        whole.where("words > 1")
        .select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .withColumn("head", F.array_join(F.slice(parts, 1, F.col("k")), " "))
        .withColumn("tail", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    )
    cuts = _looked_up(_looked_up(cuts, whole, total, "head", "l"), whole, total, "tail", "r")
    cuts = cut_lineage(_looked_up(cuts.withColumn("none", F.lit("")), languages, total, "none", "n").drop("none"))
    # What a longer phrase holds as often is held as often by one that is one word longer.
    longer = cuts.where("words > 2")
    needless = (
        longer.where("k = words - 1 and a >= l").select("lang", F.col("head").alias("phrase"))
        .union(longer.where("k = 1 and a >= r").select("lang", F.col("tail").alias("phrase")))
        .distinct()
    )
    score = F.expr("(cast(a * 1000 as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    )
    return best.join(needless, ["lang", "phrase"], "left_anti").select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language, with rank; tasks rank shares of a language before one ranks what is left."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return first.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first `top` collocations of two to five words per language, of phrases with `least` occurrences or more.

    A missing text is an empty one, a missing lang is 'und'. Repeated rows and ids count
    each. Ties in score go by count, then by phrase. Very long texts are read whole. No
    phrase of enough occurrences, no rows. Other columns are not looked at.
    """
    counts = cut_lineage(phrase_counts(docs, least))
    return ranked(scored(counts, least), top)
