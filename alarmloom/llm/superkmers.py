"""Repeated word windows by super-k-mers.

Windows of a text that share a minimiser (the smallest hash of a word pair in them) and
follow each other travel as one packed string to the bucket of the minimiser, where
sorting the windows finds equal ones exactly. Pairs of long words come first in the
order of hashes, as they are rarer. A minimiser with more strings than a bucket should
hold is told apart by a second one over longer runs of words. Of strings that a block
holds more than once, only that of the smallest document travels; the others are settled
on the spot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alarmloom.llm.shared import (
    BUCKETS,
    BUCKETS_SQL,
    RANGES_SQL,
    WordHashes,
    batch,
    blocks,
    bucket_count,
    by_bucket,
    covered,
    mix,
    pack,
    range_rows,
    read_ranges,
    referenced,
    runs,
    shingles,
    sliding_min,
    steps,
    unpack,
    with_ranges,
)

WINDOW = 13
# Words of a minimiser, and of the second one.
GRAM, LONG_GRAM = 2, 8
# Bytes from which a pair of words counts as rare.
RARE_BYTES = 12
SHARD_BYTES = 4 << 20
# One document in so many tells which minimisers are hot, from so many strings on.
HOT_SAMPLE, HOT_STRINGS = 32, 20_000

RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("text", pa.string()),
    ]
)


class Strings:
    """Super-k-mers of a block of texts: first word and number of words, document, minimiser."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, window: int, hot: np.ndarray):
        split = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.words = [w for ws in split for w in ws]
        self.first = np.cumsum(self.sizes) - self.sizes
        n = len(self.words)
        self.values = hashes.of(self.words)
        doc = np.repeat(np.arange(len(texts)), self.sizes)
        starts = max(0, n - window + 1)
        valid = doc[:starts] == doc[window - 1 : window - 1 + starts]
        lengths = np.fromiter(map(len, self.words), np.int64, n)
        gram = min(GRAM, window)
        key = shingles(self.values, gram)
        if gram == 2 and n > 1:
            short = lengths[:-1] + lengths[1:] < RARE_BYTES
            key = (key >> np.uint64(1)) | (short.astype(np.uint64) << np.uint64(63))
        least = sliding_min(key, window - gram + 1)[:starts]
        if len(hot) and starts:
            place = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
            is_hot = hot[place] == least
            if is_hot.any():
                long = min(LONG_GRAM, window)
                second = sliding_min(shingles(self.values, long, salt=7), window - long + 1)[:starts]
                least = np.where(is_hot, mix(least ^ second), least)
        change = np.ones(starts, bool)
        if starts:
            change[1:] = (least[1:] != least[:-1]) | (doc[1:starts] != doc[: starts - 1]) | ~valid[: starts - 1]
        at = np.flatnonzero(change & valid)
        # A string ends where the next one starts, or where windows would cross texts.
        stop = np.flatnonzero(np.append(change | ~valid, True))
        end = stop[np.searchsorted(stop, at, side="right")]
        self.start, self.count = at, end - at
        self.n_words = self.count + window - 1
        self.doc, self.least = doc[at] if n else at, least[at]

    def digests(self) -> np.ndarray:
        """Hash of the words of each string."""
        n = len(self.values)
        power = np.cumprod(np.full(n + 1, np.uint64(0xD6E8FEB86659FD93)))
        inverse = np.cumprod(np.full(n + 1, np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))))
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.values) * power[:n])))
        value = (total[self.start + self.n_words] - total[self.start]) * inverse[self.start]
        return mix(mix(value) ^ self.n_words.astype(np.uint64))


def hot_minimisers(rows: DataFrame, window: int) -> np.ndarray:
    """Minimisers that so many strings share that a bucket would be too large, from a sample.

    This steers where strings travel and changes no result. At most one value in
    HOT_STRINGS strings can be hot.
    """

    def work(batches):
        hashes = WordHashes()
        for part in blocks(batches, limit=SHARD_BYTES):
            found = Strings(part.column("text").to_pylist(), hashes, window, np.empty(0, np.uint64))
            value, n = np.unique(found.least, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["value", "n"])

    some = rows.where(F.pmod(F.xxhash64("ref"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(work, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= HOT_STRINGS // HOT_SAMPLE).select("value").toArrow().column("value").to_numpy()
    return np.sort(found.view(np.uint64))


def _spread(rows: DataFrame, window: int, n_buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed strings by bucket; ranges that a block settles go to buckets of their own."""

    def work(batches):
        hashes = WordHashes()
        for part in blocks(batches, limit=SHARD_BYTES):
            found = Strings(part.column("text").to_pylist(), hashes, window, hot)
            ids, refs = (np.array(part.column(c), np.int64) for c in ("id", "ref"))
            own = found.digests()
            order = np.lexsort((ids[found.doc], own))
            again = np.zeros(len(order), bool)
            if len(order):
                ranked, rank_id = own[order], ids[found.doc][order]
                head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
                least = rank_id[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
                again[order] = rank_id > least
            out: list[list] = [[], []]
            local = found.start - found.first[found.doc]
            if again.any():
                at = np.flatnonzero(again)
                ranges = pack(refs[found.doc[at]], local[at], local[at] + found.n_words[at])
                out[0].append(n_buckets + int(refs[0] % n_buckets))
                out[1].append(ranges)
            keep = np.flatnonzero(~again)
            bucket = ((mix(found.least[keep]) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            words = found.words
            for b, at in by_bucket(bucket):
                at = keep[at]
                first, size = found.start[at].tolist(), found.n_words[at].tolist()
                text = b" ".join([b" ".join(words[a : a + k]) for a, k in zip(first, size)])
                docs, place = np.unique(found.doc[at], return_inverse=True)
                out[0].append(b)
                out[1].append(
                    pack(
                        steps(ids[docs]),
                        steps(refs[docs]),
                        steps(place.astype(np.int32)),
                        local[at].astype(np.int32),
                        found.n_words[at].astype(np.int32),
                        text,
                    )
                )
            yield batch(BUCKETS, out)

    return rows.select("id", "ref", "text").mapInArrow(work, BUCKETS_SQL)


def repeated(values: np.ndarray, size: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which window starts among the word hashes of strings begin a window that a smaller document has.

    size and ids tell the number of words and the document of each string. Windows are
    sorted by a 64-bit hash; a second one tells apart what should collide.
    """
    first = np.cumsum(size) - size
    count = size - window + 1
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    owner = np.repeat(ids, count)
    one = shingles(values, window)[at]
    order = np.lexsort((owner, one))
    ranked = one[order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    two = shingles(values, window, salt=1)[at]
    if ((two[order][1:] != two[order][:-1]) & ~head[1:]).any():
        order = np.lexsort((owner, two, one))
        ranked, two = one[order], two[order]
        head = np.concatenate(([True], (ranked[1:] != ranked[:-1]) | (two[1:] != two[:-1])))
    least = owner[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    out = np.zeros(len(values), bool)
    out[at[order]] = owner[order] > least
    return out


def _sorted(spread: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Ranges of words to remove, from each bucket."""

    def work(table: pa.Table) -> pa.Table:
        bucket, packed = table.column("bucket")[0].as_py(), table.column("packed").to_pylist()
        if bucket >= n_buckets:
            parts = [unpack(x, np.int64, np.int64, np.int64) for x in packed]
            return pa.table(_range_columns(*(np.concatenate(x) for x in zip(*parts))), names=["ref", "ranges"])
        ids, refs, local, size, values, hashes = [], [], [], [], [], WordHashes()
        for x in packed:
            id_steps, ref_steps, place, start, n, text = unpack(x, np.int64, np.int64, np.int32, np.int32, np.int32, None)
            at = np.cumsum(place)
            ids.append(np.cumsum(id_steps)[at])
            refs.append(np.cumsum(ref_steps)[at])
            local.append(start)
            size.append(n)
            values.append(hashes.of(text.split()))
        ids, refs, local, size = (np.concatenate(x).astype(np.int64) for x in (ids, refs, local, size))
        del hashes
        hit = repeated(np.concatenate(values), size, ids, window)
        # An unmarked place after each string keeps runs inside them.
        marked = np.zeros(len(hit) + len(size), bool)
        marked[np.arange(len(hit)) + np.repeat(np.arange(len(size)), size)] = hit
        start, end = runs(marked)
        first = np.cumsum(size + 1) - size - 1
        owner = np.searchsorted(first, start, side="right") - 1
        low = local[owner] + start - first[owner]
        columns = _range_columns(refs[owner], low, low + (end - start) + window - 1)
        return pa.table(columns, names=["ref", "ranges"])

    return spread.groupBy("bucket").applyInArrow(work, RANGES_SQL)


def _range_columns(ref: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    refs, ranges = range_rows(ref, start, end)
    return [pa.array(refs, pa.int64()), pa.array(ranges, pa.binary())]


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes words in windows that also start in a document with a smaller doc_id.

    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    blank) and text (those words), one row per row of docs. Windows are judged on the
    input. A missing text has no words; a missing doc_id counts as larger than any other;
    rows with the same doc_id do not remove each other's words. Other columns of docs are
    not looked at.
    """
    rows = referenced(docs)
    n_buckets = bucket_count(docs)
    spread = _spread(rows, window, n_buckets, hot_minimisers(rows, window))
    found = with_ranges(rows.select("doc_id", "ref", "text"), _sorted(spread, window, n_buckets))

    def work(batches):
        for part in blocks(batches):
            columns: list[list] = [[] for _ in RESULT]
            for doc_id, text, packed in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "ranges"))):
                words = text.split()
                kept, gone = words, 0
                if packed:
                    ranges = read_ranges(packed)
                    hit = covered(len(words), ranges[:, 0], ranges[:, 1])
                    kept = [w for w, h in zip(words, hit.tolist()) if not h]
                    gone = len(words) - len(kept)
                left = b" ".join(kept)
                values = [doc_id, len(words), gone, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")]
                for column, value in zip(columns, values):
                    column.append(value)
            yield batch(RESULT, columns)

    return found.select("doc_id", "text", "ranges").mapInArrow(
        work, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string"
    )
