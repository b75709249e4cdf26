"""Language-model scores of documents by subword lattices, beside a word baseline.

The pieces of an existing vocabulary span a lattice over every word. Their scores weight
every segmentation: a Zipf prior by rank is adapted by expectation-maximisation to the
words of all training documents, counted once. A forward recursion in log space gives the
marginal probability of a word's pieces; a document's probability is the product over its
words and its end.

The baseline needs the training count of every word of every document. Words that many
documents have are counted by themselves and sent to the tasks; the number of such words
is bounded by the words of a document over their share. The others travel once, packed by bucket with the
documents that have them, so no word brings a large group to one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from alarmloom.llm.pieces import BLANK, MEMO_CHARS, PIECE_BASE, NOTHING, TOGETHER, VOCABULARY, Encoder, held_encoder, vocabulary
from alarmloom.llm.shared import (
    BUCKETS,
    BUCKETS_SQL,
    MEMO_WORDS,
    Vocabulary,
    batch,
    blocks,
    bucket_count,
    by_bucket,
    pack,
    referenced,
    steps,
    unpack,
)
from alarmloom.operators.sizing import cut_lineage

# A word is common if one of so many documents has it, found in a sample of documents.
COMMON_SHARE, COMMON_SAMPLE, COMMON_LEAST = 500, 32, 8
# Rounds in which the words of the training documents adapt the prior.
START_ROUNDS = 6
LEAST_WEIGHT = 1e-9
LATTICE_BUCKET = 32 << 20
WORD, TOTAL = 0, 1

ANSWER_SQL = "block bigint, packed binary, n_types bigint"
SUM_SQL = "ref bigint, log_sum double, n_known bigint, score double, n_tokens bigint, n_rows bigint, n_types bigint"


class Lattice:
    """Marginal log10 probabilities of words under log10 probabilities of pieces."""

    def __init__(self, encoder: Encoder, weights: np.ndarray):
        self.encoder = encoder
        self.weights = np.log(weights)

    def fallback(self, sign: str) -> float:
        return float(self.weights[self.encoder.fallback(sign)].sum())

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Words in order of length, TOGETHER at a time: places and marked texts; a long word comes alone."""
        text = [self.encoder.marked(w.decode("utf-8", "replace")) for w in words]
        order = np.argsort(np.array([len(t) for t in text], np.int64), kind="stable")
        cut = sum(len(t) <= MEMO_CHARS for t in text)
        for low in range(0, cut, TOGETHER):
            at = order[low : min(cut, low + TOGETHER)]
            yield at, [text[i] for i in at]
        for i in order[cut:]:
            yield np.array([i]), [text[i]]

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Words of any lengths, as UTF-8 bytes without blanks."""
        out = np.empty(len(words))
        for at, some in self._groups(words):
            if len(some[0]) > MEMO_CHARS:
                out[at] = self._alone(some[0])
            else:
                out[at] = self._reach(some, None)[[len(w) for w in some], np.arange(len(some))]
        return out / math.log(10)

    def _reach(self, words: list[str], edges: list | None) -> np.ndarray:
        """Forward recursion over words side by side, a place at a time.

        Row j holds the log sums over all segmentations of the first j signs. Pieces go to
        edges as (from, to, words, ids), if those are asked for.
        """
        lookup, longest = self.encoder.lookup, self.encoder.longest
        size = np.array([len(w) for w in words], np.int64)
        n = int(size.max())
        signs = np.frombuffer("".join(w.ljust(n) for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        signs = np.ascontiguousarray(signs.T).astype(np.uint64) + np.uint64(1)
        reach = np.full((n + 1, len(words)), -np.inf)
        reach[0] = 0
        for i in range(n):
            alive = np.flatnonzero(size > i)
            hashed = np.zeros(len(alive), np.uint64)
            for j in range(i + 1, min(n, i + longest) + 1):
                within = size[alive] >= j
                if not within.all():
                    alive, hashed = alive[within], hashed[within]
                if not len(alive):
                    break
                hashed = hashed * PIECE_BASE + signs[j - 1, alive]
                found, _ = lookup.find(hashed)
                usable = found >= 0
                if j == i + 1:
                    for k in alive[~usable].tolist():
                        more = reach[i, k] + self.fallback(words[k][i])
                        reach[j, k] = np.logaddexp(reach[j, k], more)
                at = alive[usable]
                reach[j, at] = np.logaddexp(reach[j, at], reach[i, at] + self.weights[found[usable]])
                if edges is not None:
                    edges.append((i, j, at, found[usable]))
                on = found > NOTHING
                alive, hashed = alive[on], hashed[on]
        return reach

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of the words, by forward and backward sums."""
        out = np.zeros(len(self.weights))
        for at, some in self._groups(words):
            if len(some[0]) > MEMO_CHARS:
                self._expected_alone(some[0], float(times[at[0]]), out)
                continue
            edges: list[tuple] = []
            reach = self._reach(some, edges)
            left = self._left(some, edges)
            total = reach[[len(w) for w in some], np.arange(len(some))]
            shares = [np.exp(reach[i, who] + self.weights[ids] + left[j, who] - total[who]) * times[at[who]] for i, j, who, ids in edges]
            if edges:
                out += np.bincount(np.concatenate([e[3] for e in edges]), weights=np.concatenate(shares), minlength=len(out))
        return out

    def _left(self, words: list[str], edges: list) -> np.ndarray:
        """Backward recursion over the edges of the forward one; signs without a piece add their bytes."""
        size = np.array([len(w) for w in words], np.int64)
        n = int(size.max())
        left = np.full((n + 1, len(words)), -np.inf)
        left[size, np.arange(len(words))] = 0
        by_start: dict[int, list] = {}
        for edge in edges:
            by_start.setdefault(edge[0], []).append(edge)
        for i in range(n - 1, -1, -1):
            alone = size > i
            for _, j, who, ids in by_start.get(i, ()):
                left[i, who] = np.logaddexp(left[i, who], self.weights[ids] + left[j, who])
                if j == i + 1:
                    alone[who] = False
            for k in np.flatnonzero(alone).tolist():
                left[i, k] = np.logaddexp(left[i, k], self.fallback(words[k][i]) + left[i + 1, k])
        return left

    def _alone(self, word: str) -> float:
        return self._reach_alone(word)[len(word)]

    def _arcs(self, word: str, i: int) -> Iterator[tuple[int, int | None, float]]:
        """Ends, ids and weights of the pieces from place i; a sign without a piece is its bytes, without an id."""
        table, single = self.encoder.table, False
        for j in range(i + 1, min(len(word), i + self.encoder.longest) + 1):
            if word[i:j] not in table:
                break
            entry = table[word[i:j]]
            if entry is not None:
                single = single or j == i + 1
                yield j, entry[0], float(self.weights[entry[0]])
        if not single:
            yield i + 1, None, self.fallback(word[i])

    def _reach_alone(self, word: str) -> list[float]:
        """Forward recursion over one long word."""
        reach = [0.0] + [-math.inf] * len(word)
        for i in range(len(word)):
            for j, _, weight in self._arcs(word, i):
                reach[j] = _log_add(reach[j], reach[i] + weight)
        return reach

    def _expected_alone(self, word: str, times: float, out: np.ndarray) -> None:
        """Adds the expected pieces of one long word; the arcs are found again on the way back and not held."""
        reach, n = self._reach_alone(word), len(word)
        left = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            for j, piece, weight in self._arcs(word, i):
                left[i] = _log_add(left[i], weight + left[j])
                if piece is not None:
                    out[piece] += times * math.exp(reach[i] + weight + left[j] - reach[n])


def _log_add(one: float, other: float) -> float:
    low, high = sorted((one, other))
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _sized(value: int, n: int, array: np.ndarray) -> np.ndarray:
    return np.concatenate((array, np.full(n - len(array), value, array.dtype)))


def _read(part: pa.RecordBatch, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words of the texts, lower-cased, the text of each and the words of each text."""
    split = [t.lower().split() for t in part.column("text").to_pylist()]
    sizes = np.array([len(w) for w in split], np.int64)
    return known.of([w for ws in split for w in ws]), np.repeat(np.arange(len(split)), sizes), sizes


def common_words(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of words that many documents of a sample have; where words travel depends on it, no result."""

    def work(batches):
        for part in blocks(batches):
            known = Vocabulary()
            numbers, owner, sizes = _read(part, known)
            pairs = np.unique(numbers.astype(np.int64) * len(sizes) + owner)
            n = np.bincount(pairs // max(1, len(sizes)), minlength=len(known.words))
            value = np.concatenate((known.hashes.view(np.int64), [0]))
            kind = np.concatenate((np.full(len(n), WORD), [TOTAL]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int64()), pa.array(value, pa.int64()), pa.array(np.append(n, len(sizes)), pa.int64())],
                ["kind", "value", "n"],
            )

    some = rows.where(F.pmod(F.xxhash64("ref"), F.lit(COMMON_SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(work, "kind bigint, value bigint, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.where((F.col("n") >= COMMON_LEAST) | (F.col("kind") == TOTAL)))
    total = counts.where(F.col("kind") == TOTAL).agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(COMMON_LEAST, total / COMMON_SHARE)
    found = counts.where((F.col("kind") == WORD) & (F.col("n") >= least)).select("value").toArrow()
    return np.sort(found.column("value").to_numpy().view(np.uint64))


def prior(entries: list) -> np.ndarray:
    """Zipf shares of the pieces by rank; control pieces have next to none."""
    weights = np.array([math.exp(score / 256) if piece or is_byte else 0.0 for piece, score, is_byte in entries])
    return np.maximum(weights / weights.sum(), LEAST_WEIGHT)


def _word_counts(rows: DataFrame) -> DataFrame:
    """Occurrences of every word of the training documents: word, n."""

    def given(known: Vocabulary, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(known.words), 10_000):
            some = pa.array(known.words[low : low + 10_000], pa.binary())
            yield pa.RecordBatch.from_arrays([some, pa.array(counts[low : low + 10_000], pa.int64())], ["word", "n"])

    def words(batches):
        known, counts = Vocabulary(), np.empty(0, np.int64)
        for part in blocks(batches):
            if len(known.words) > MEMO_WORDS:
                yield from given(known, counts)
                known, counts = Vocabulary(), np.empty(0, np.int64)
            numbers, _, _ = _read(part, known)
            counts = _sized(0, len(known.words), counts)
            counts += np.bincount(numbers, minlength=len(known.words))
        yield from given(known, counts)

    counted = rows.where("train").select("text").mapInArrow(words, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def adapted(table: DataFrame, entries: list) -> np.ndarray:
    """Weights of the pieces after START_ROUNDS of expectation-maximisation on the counted words of training."""
    context = table.sparkSession.sparkContext
    weights = prior(entries)
    known = context.broadcast({"entries": entries})
    for _ in range(START_ROUNDS):
        sent = context.broadcast(weights)

        def estimate(batches, sent=sent):
            lattice, total = Lattice(held_encoder(known.value), sent.value), np.zeros(len(sent.value))
            for part in batches:
                n = part.column("n").to_numpy().astype(np.float64)
                total += lattice.expected(part.column("word").to_pylist(), n)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "n"])

        found = table.mapInArrow(estimate, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(entries))
        counts[found.column("piece").to_numpy()] = found.column("n").to_numpy()
        if not counts.sum():
            break
        weights = np.maximum(counts / counts.sum(), LEAST_WEIGHT)
        sent.destroy()
    return weights / weights.sum()


def train(rows: DataFrame, common: np.ndarray, entries: list) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Training counts of the common words, weights of the pieces, and numbers of words and texts.

    Texts are read once for the counts of their words; all else reads the distinct words.
    """
    table = cut_lineage(_word_counts(rows))
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def named(batches):
        hot = sent.value
        for part in batches:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, part.column("word").to_pylist()), np.uint64, part.num_rows)
            at = np.flatnonzero(np.isin(hashes, hot))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), part.column("n").take(at)], ["value", "n"])

    found = table.mapInArrow(named, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n")).toArrow()
    words = np.zeros(len(common), np.int64)
    words[np.searchsorted(common, found.column("value").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    n_words = table.agg(F.sum("n").alias("n")).first()["n"] or 0
    return words, adapted(table, entries), n_words, rows.where("train").count()


def _spread(
    rows: DataFrame,
    common: np.ndarray,
    counts: np.ndarray,
    entries: list,
    weights: np.ndarray,
    sizes_of: tuple[int, int],
    n_buckets: int,
) -> DataFrame:
    """Rare words with their documents by bucket; what a task knows of a document goes to buckets of its own."""
    sent = rows.sparkSession.sparkContext.broadcast(
        {"common": common, "counts": counts, "entries": entries, "weights": weights}
    )
    n_train, n_texts = sizes_of
    end = (n_texts + 1) / (n_train + n_texts + 2)

    def work(batches):
        hot, hot_counts = sent.value["common"], sent.value["counts"]
        lattice = Lattice(held_encoder(sent.value), sent.value["weights"])
        hot_logs = np.append(np.log10(hot_counts + 0.5), 0)
        known, place, score = Vocabulary(), np.empty(0, np.int64), np.empty(0)
        for part in blocks(batches):
            if len(known.words) > MEMO_WORDS:
                known, place, score = Vocabulary(), np.empty(0, np.int64), np.empty(0)
            numbers, owner, sizes = _read(part, known)
            n_docs, fresh = len(sizes), known.words[len(place) :]
            if fresh:
                at = np.searchsorted(hot, known.hashes[len(place) :])
                is_hot = np.append(hot, 0)[at] == known.hashes[len(place) :]
                place = np.concatenate((place, np.where(is_hot & (at < len(hot)), at, len(hot))))
                score = np.concatenate((score, lattice.log10(fresh)))
            refs = np.array(part.column("ref"), np.int64)
            training = part.column("train").to_numpy(zero_copy_only=False)
            at = place[numbers]
            is_hot = at < len(hot)
            logs = np.bincount(owner, weights=hot_logs[at], minlength=n_docs).astype(np.float64)
            seen = is_hot & (np.append(hot_counts, 0)[at] > 0)
            n_known = np.bincount(owner[seen], minlength=n_docs)
            total = np.bincount(owner, weights=score[numbers], minlength=n_docs) + math.log10(end)
            total += sizes * math.log10(1 - end)
            out: list[list] = [[], []]
            out[0].append(n_buckets + int(refs[0] % n_buckets))
            out[1].append(pack(refs, logs, n_known.astype(np.int64), sizes + 1, total))
            pairs, times = np.unique(numbers[~is_hot].astype(np.int64) * n_docs + owner[~is_hot], return_counts=True)
            word, doc = pairs // n_docs, pairs % n_docs
            bucket = ((known.hashes[word] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            for b, at in by_bucket(bucket):
                own, first, counted = np.unique(word[at], return_index=True, return_counts=True)
                learnt = np.add.reduceat(times[at] * training[doc[at]], first)
                docs, index = np.unique(doc[at], return_inverse=True)
                out[0].append(b)
                out[1].append(
                    pack(
                        known.hashes[own],
                        counted.astype(np.int32),
                        learnt.astype(np.int32),
                        refs[:1],
                        steps(refs[docs]),
                        index.astype(np.int32),
                        times[at].astype(np.int32),
                    )
                )
            yield batch(BUCKETS, out)

    return rows.select("ref", "text", "train").mapInArrow(work, BUCKETS_SQL)


def _summed(spread: DataFrame, n_buckets: int) -> DataFrame:
    """Sums by document: every packed piece is answered by one for the block it came from, and blocks add up theirs.

    n_types counts the distinct words that training has, on any of the rows.
    """

    def answer(table: pa.Table) -> pa.Table:
        bucket, packed = table.column("bucket")[0].as_py(), table.column("packed").to_pylist()
        out: list[list] = [[], []]
        if bucket >= n_buckets:
            for x in packed:
                refs, logs, known, tokens, scores = unpack(x, np.int64, np.float64, np.int64, np.int64, np.float64)
                out[0].append(int(refs[0]))
                out[1].append(pack(refs, logs, known, scores, tokens))
            return _answers(out, 0)
        kinds = (np.uint64, np.int32, np.int32, np.int64, np.int64, np.int32, np.int32)
        held = [unpack(x, *kinds) for x in packed]
        hashes, learnt = (np.concatenate([h[k] for h in held]) for k in (0, 2))
        types, place = np.unique(hashes, return_inverse=True)
        count = np.bincount(place, weights=learnt, minlength=len(types))
        at = 0
        for own, counted, _, block, ref, index, times in held:
            each = count[place[at : at + len(own)]]
            at += len(own)
            each, n = np.repeat(each, counted), len(ref)
            sums = (times * np.log10(each + 0.5), times * (each > 0))
            logs, known = (np.bincount(index, weights=w, minlength=n) for w in sums)
            out[0].append(int(block[0]))
            out[1].append(pack(np.cumsum(ref), logs, known.astype(np.int64), np.zeros(n), np.zeros(n, np.int64)))
        return _answers(out, int((count > 0).sum()))

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack(x, np.int64, np.float64, np.int64, np.float64, np.int64) for x in table.column("packed").to_pylist()]
        ref, *values = (np.concatenate(x) for x in zip(*parts))
        refs, owner = np.unique(ref, return_inverse=True)
        logs, known, scores = (np.bincount(owner, weights=v, minlength=len(refs)) for v in values[:3])
        own = values[3] > 0
        tokens = np.zeros(len(refs), np.int64)
        tokens[owner[own]] = values[3][own]
        n_types = np.zeros(len(refs), np.int64)
        n_types[0] = sum(table.column("n_types").to_pylist())
        columns = [refs, logs, known.astype(np.int64), scores, tokens, np.bincount(owner[own], minlength=len(refs)), n_types]
        return pa.table(columns, names=["ref", "log_sum", "n_known", "score", "n_tokens", "n_rows", "n_types"])

    answers = spread.groupBy("bucket").applyInArrow(answer, ANSWER_SQL)
    parts = answers.groupBy("block").applyInArrow(add, SUM_SQL)
    sums = [F.sum(c).alias(c) for c in ("log_sum", "n_known", "score", "n_rows", "n_types")]
    # Rows that repeat one text share a ref, and may be in several blocks.
    return parts.groupBy("ref").agg(*sums, F.max("n_tokens").alias("n_tokens"))


def _answers(out: list[list], n_types: int) -> pa.Table:
    counted = [n_types] + [0] * (len(out[0]) - 1)
    columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(counted, pa.int64())]
    return pa.table(columns, names=["block", "packed", "n_types"])


def score(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32(doc_id as text) mod 5 is not 1.

    Tokens are words, A-Z lower-cased, and one end per text. Columns: doc_id, held_out,
    n_tokens, n_known (tokens that training has), train_tokens, base_score (sum of
    log10((c + 0.5) / (N + 0.5 (V + 1)))) and score (log10 probability under the lattice).
    A missing text is empty, a missing doc_id an empty text. Other columns of docs are
    not looked at. Rows that repeat an id and a text are scored alike and each count in training;
    very long texts and words are scored whole.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = referenced(docs).withColumn("train", ~held_out)
    entries = vocabulary(path)
    common = common_words(rows)
    counts, weights, n_words, n_texts = train(rows, common, entries)
    n_train = n_words + n_texts
    n_buckets = bucket_count(docs, LATTICE_BUCKET)
    spread = _spread(rows, common, counts, entries, weights, (n_words, n_texts), n_buckets)
    summed = cut_lineage(_summed(spread, n_buckets))
    types = summed.agg(F.sum("n_types").alias("n")).first()["n"] or 0
    n_types = types + int((counts > 0).sum()) + (1 if n_texts else 0)
    total = math.log10(n_train + 0.5 * (n_types + 1))
    ends = math.log10(n_texts + 0.5)
    known_end = 1 if n_texts else 0
    out = rows.select("doc_id", "ref", "train").join(summed, "ref")
    return out.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") / F.col("n_rows") + known_end).cast("bigint").alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") / F.col("n_rows") + ends - F.col("n_tokens") * total).alias("base_score"),
        (F.col("score") / F.col("n_rows")).alias("score"),
    )
