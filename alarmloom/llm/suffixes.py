"""Repeated byte strings by a depth-limited radix sort of suffixes.

Only the first `depth` bytes of a suffix matter, so suffixes are ordered by
most-significant digits until that depth and no further. Of the windows (suffixes cut
at the depth) those are handled together that hold the same anchor, the string of DIGIT
bytes with the smallest hash in the window, as equal windows have equal anchors.

Pass 1, digit: the anchor. Groups of one leave.
Pass 2, digit: the whole string that a run of windows with one anchor covers. Groups of
two or more are repeated in full; one of each stays as their representative where an
anchor has several strings.
Pass 3, digit: the full depth, for the windows of the representatives that are left.
Equal groups are exactly the repeated windows.

A digit is a 64-bit hash of its bytes. Strings are compared by anchor and whole string, 128
bits; windows of the last pass by one hash inside buckets that a second hash deals out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alarmloom.llm.shared import (
    BUCKETS,
    BUCKETS_SQL,
    RANGES_SQL,
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
    sliding_min,
    steps,
    unpack,
    with_ranges,
)
from alarmloom.operators.sizing import cut_lineage, small_side

DEPTH = 400
# Bytes of an anchor: half of the depth.
DIGIT = 200
# Bytes that a task hashes together; a longer text is cut into parts that overlap by a window.
PART_BYTES = 256 << 10
# Windows of the last pass that a task holds before it sends them.
HELD_WINDOWS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SIGNS = [mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64)) for k in range(2)]

RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.binary()),
    ]
)
FOUND_SQL = "ref bigint, ranges binary, asked binary"


class Hashes:
    """Hashes of any substring of a buffer, from running sums of powers."""

    def __init__(self, kind: int = 0):
        self.signs = SIGNS[kind]
        self.up = self.down = np.ones(1, np.uint64)

    def read(self, buffer: bytes) -> None:
        n = len(buffer)
        if len(self.up) <= n:
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE))))
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, INVERSE))))
        values = self.signs[np.frombuffer(buffer, np.uint8)]
        values *= self.up[:n]
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Hash of the `size` bytes from each place."""
        n = len(self.sums) - size
        out = self.sums[size:] - self.sums[:n]
        out *= self.down[:n]
        return mix(out)


def parts(texts: list[bytes], depth: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of texts: bytes, and for each piece its text, its place in the buffer and in the text.

    Windows start in one piece only; a piece ends with the bytes that its last windows need.
    """
    held, doc, place, local, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for low in range(0, max(1, len(text) - depth + 1), PART_BYTES):
            piece = text[low : low + PART_BYTES + depth - 1]
            if len(piece) < depth:
                continue
            if held and size + len(piece) > PART_BYTES:
                yield b"".join(held), np.array(doc), np.array(place), np.array(local)
                held, doc, place, local, size = [], [], [], [], 0
            held.append(piece)
            doc.append(i)
            place.append(size)
            local.append(low)
            size += len(piece)
    if held:
        yield b"".join(held), np.array(doc), np.array(place), np.array(local)


def anchored(hashes: Hashes, n: int, place: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, number, digit of the anchor and of the run's string."""
    grams = hashes.every(digit)
    key = (grams & ~np.uint64((1 << 22) - 1)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(key, depth - digit + 1)
    at = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
    ends = np.append(place[1:], n)
    change = np.ones(len(at), bool)
    change[1:] = at[1:] != at[:-1]
    change[place] = True
    # Windows that reach over the end of a piece are none.
    valid = np.zeros(len(at) + 1, np.int8)
    valid[place] += 1
    valid[np.minimum(ends - depth + 1, len(at))] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    start = np.flatnonzero(change & valid)
    stop = np.flatnonzero(np.append(change | ~valid, True))
    end = stop[np.searchsorted(stop, start, side="right")]
    anchor = at[start]
    whole = hashes.of(start, end + depth - 1)
    shape = (end - start).astype(np.uint64) << np.uint64(32) | (anchor - start).astype(np.uint64)
    return start, end - start, grams[anchor], mix(whole ^ mix(shape))


def _dealt(hashed: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of equal shares of all hashes."""
    return ((hashed >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _first_digits(rows: DataFrame, depth: int, digit: int, n_buckets: int) -> DataFrame:
    """Runs packed by the bucket of their anchor; what a block settles goes to buckets of its own."""

    def work(batches):
        hashes = Hashes()
        for part in blocks(batches):
            refs = np.array(part.column("ref"), np.int64)
            out: list[list] = [[], []]
            for buffer, doc, place, local in parts(part.column("text").to_pylist(), depth):
                hashes.read(buffer)
                start, count, one, two = anchored(hashes, len(buffer), place, depth, digit)
                piece = np.searchsorted(place, start, side="right") - 1
                owner, low = doc[piece], start - place[piece] + local[piece]
                order = np.lexsort((one, two))
                same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
                again, repeated = np.zeros(len(order), bool), np.zeros(len(order), np.uint8)
                again[order[1:]] = same
                repeated[order[:-1][same]] = 1
                known = np.flatnonzero(again | (repeated > 0))
                if len(known):
                    out[0].append(n_buckets + int(refs[0] % n_buckets))
                    out[1].append(pack(refs[owner[known]], low[known], low[known] + count[known] + depth - 1))
                keep = np.flatnonzero(~again)
                # Digits of anchors are small, as each is the least of its window.
                for b, at in by_bucket(_dealt(mix(one[keep]), n_buckets)):
                    at = keep[at]
                    docs, index = np.unique(owner[at], return_inverse=True)
                    out[0].append(b)
                    out[1].append(
                        pack(
                            one[at],
                            two[at],
                            steps(refs[docs]),
                            steps(index.astype(np.int32)),
                            low[at].astype(np.int64),
                            count[at].astype(np.int32),
                            repeated[at],
                        )
                    )
            yield batch(BUCKETS, out)

    return rows.select("ref", "text").mapInArrow(work, BUCKETS_SQL)


def grouped(one: np.ndarray, two: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passes 1 and 2 on the runs of a bucket: which are repeated in full, and which are to be looked at deeper.

    Deeper go one run of each string of an anchor that has several strings.
    """
    order = np.lexsort((two, one))
    a, b, r = one[order], two[order], repeated[order] > 0
    n = len(order)
    new_one = np.concatenate(([True], a[1:] != a[:-1]))
    new_two = new_one | np.concatenate(([True], b[1:] != b[:-1]))
    string = np.cumsum(new_two) - 1
    group = np.cumsum(new_one) - 1
    size = np.bincount(string)
    marked = np.bincount(string, weights=r) > 0
    full = ((size > 1) | marked)[string]
    several = np.bincount(group[new_two]) > 1
    deeper = new_two & several[group]
    out_full, out_deeper = np.zeros(n, bool), np.zeros(n, bool)
    out_full[order], out_deeper[order] = full, deeper
    return out_full, out_deeper


def _second_digits(spread: DataFrame, depth: int, n_buckets: int) -> DataFrame:
    """ranges of bytes that are repeated, and asked: runs (start, number of windows, already known)."""

    def work(table: pa.Table) -> pa.Table:
        bucket, packed = table.column("bucket")[0].as_py(), table.column("packed").to_pylist()
        if bucket >= n_buckets:
            found = [np.concatenate(x) for x in zip(*(unpack(x, np.int64, np.int64, np.int64) for x in packed))]
            return _rows(range_rows(*found), ([], []))
        held = []
        for x in packed:
            one, two, ref, index, low, count, repeated = unpack(
                x, np.uint64, np.uint64, np.int64, np.int32, np.int64, np.int32, np.uint8
            )
            held.append((one, two, np.cumsum(ref)[np.cumsum(index)], low, count.astype(np.int64), repeated))
        one, two, ref, low, count, repeated = (np.concatenate(x) for x in zip(*held))
        full, deeper = grouped(one, two, repeated)
        # Runs marked by their block have been sent as ranges there.
        at = np.flatnonzero(full & (repeated == 0))
        ranges = range_rows(ref[at], low[at], low[at] + count[at] + depth - 1)
        at = np.flatnonzero(deeper)
        return _rows(ranges, range_rows(ref[at], low[at], np.where(full[at], -count[at], count[at])))

    return spread.groupBy("bucket").applyInArrow(work, FOUND_SQL)


def _rows(ranges: tuple[list, list], asked: tuple[list, list]) -> pa.Table:
    n, k = len(ranges[0]), len(asked[0])
    return pa.table(
        [
            pa.array(ranges[0] + asked[0], pa.int64()),
            pa.array(ranges[1] + [None] * k, pa.binary()),
            pa.array([None] * n + asked[1], pa.binary()),
        ],
        names=["ref", "ranges", "asked"],
    )


def _by_ref(ref: np.ndarray, place: np.ndarray, n_buckets: int) -> tuple[list[int], list[bytes]]:
    """Windows packed by the bucket of their ref."""
    out: tuple[list, list] = ([], [])
    for b, at in by_bucket(_dealt(mix(ref.astype(np.uint64)), n_buckets)):
        refs, index = np.unique(ref[at], return_inverse=True)
        out[0].append(b)
        out[1].append(pack(steps(refs), steps(index.astype(np.int32)), steps(place[at])))
    return out


def folded(value: np.ndarray, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One window of each string, and which windows have others like them."""
    order = np.argsort(value, kind="stable")
    same = (value[order][1:] == value[order][:-1]) & (dealt[order][1:] == dealt[order][:-1])
    again, twice = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order[1:]] = same
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return np.flatnonzero(~again), twice


def _last_digits(rows: DataFrame, asked: DataFrame, depth: int, n_buckets: int) -> DataFrame:
    """Ranges of the windows that are equal at full depth, among the runs asked for."""

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Windows packed by the bucket of their string; what they settle among themselves goes to buckets of its own."""
        value, dealt, ref, place, open_ = (np.concatenate(x) for x in zip(*held))
        first, twice = folded(value, dealt)
        at = np.flatnonzero(twice & open_)
        known = _by_ref(ref[at], place[at], n_buckets)
        out = [[n_buckets + b for b in known[0]], known[1]]
        open_ &= ~twice
        for b, at in by_bucket(_dealt(dealt[first], n_buckets)):
            at = first[at]
            refs, index = np.unique(ref[at], return_inverse=True)
            out[0].append(b)
            out[1].append(
                pack(value[at], steps(refs), steps(index.astype(np.int32)), steps(place[at]), open_[at].astype(np.uint8))
            )
        return batch(BUCKETS, out)

    def spread(batches):
        hashes, dealing = Hashes(), Hashes(1)
        held, size = [], 0
        for part in blocks(batches):
            for ref, text, packed in zip(*(part.column(c).to_pylist() for c in ("ref", "text", "asked"))):
                runs_of = read_ranges(packed)
                runs_of = runs_of[np.argsort(runs_of[:, 0])]
                for low in range(0, len(text), PART_BYTES):
                    own = runs_of[(runs_of[:, 0] >= low) & (runs_of[:, 0] < low + PART_BYTES)]
                    if not len(own):
                        continue
                    count = np.abs(own[:, 1])
                    high = int((own[:, 0] + count).max()) + depth - 1
                    hashes.read(text[low:high])
                    dealing.read(text[low:high])
                    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(own[:, 0], count)
                    value, dealt = (h.of(at - low, at - low + depth) for h in (hashes, dealing))
                    held.append((value, dealt, np.full(len(at), ref), at, np.repeat(own[:, 1] > 0, count)))
                    size += len(at)
                    if size > HELD_WINDOWS:
                        yield sent(held)
                        held, size = [], 0
        if held:
            yield sent(held)

    def compare(table: pa.Table) -> pa.Table:
        bucket, packed = table.column("bucket")[0].as_py(), table.column("packed").to_pylist()
        if bucket >= n_buckets:
            found = pa.repeat(pa.scalar(bucket - n_buckets, pa.int64()), len(packed))
            return pa.table([found, pa.array(packed, pa.binary())], schema=BUCKETS)
        held = []
        for x in packed:
            value, ref, index, place, open_ = unpack(x, np.uint64, np.int64, np.int32, np.int64, np.uint8)
            held.append((value, np.cumsum(ref)[np.cumsum(index)], np.cumsum(place), open_ > 0))
        value, ref, place, open_ = (np.concatenate(x) for x in zip(*held))
        group = np.unique(value, return_inverse=True)[1]
        at = np.flatnonzero((np.bincount(group)[group] > 1) & open_)
        found, packed = _by_ref(ref[at], place[at], n_buckets)
        return pa.table([pa.array(found, pa.int64()), pa.array(packed, pa.binary())], schema=BUCKETS)

    def gather(table: pa.Table) -> pa.Table:
        held = [unpack(x, np.int64, np.int32, np.int64) for x in table.column("packed").to_pylist()]
        ref, place = (np.concatenate(x) for x in zip(*[(np.cumsum(r)[np.cumsum(i)], np.cumsum(p)) for r, i, p in held]))
        order = np.lexsort((place, ref))
        ref, place = ref[order], place[order]
        new = np.append(True, (ref[1:] != ref[:-1]) | (place[1:] > place[:-1] + depth))
        last = np.append(new[1:], True)
        refs, ranges = range_rows(ref[new], place[new], place[last] + depth)
        return pa.table([pa.array(refs, pa.int64()), pa.array(ranges, pa.binary())], names=["ref", "ranges"])

    wanted = asked.groupBy("ref").agg(F.collect_list("asked").alias("asked"))
    some = rows.select("ref", "text").join(small_side(wanted.select("ref")), "ref", "left_semi")
    texts = some.join(wanted, "ref").dropDuplicates(["ref"])
    found = texts.mapInArrow(spread, BUCKETS_SQL).groupBy("bucket").applyInArrow(compare, BUCKETS_SQL)
    return found.groupBy("bucket").applyInArrow(gather, RANGES_SQL)


def deduplicate(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """Removes every byte covered by a `depth`-byte string that also starts anywhere else.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and
    kept (the remaining bytes), one row per row of docs. Texts are UTF-8 bytes, a missing
    one is empty; matches never cross documents, overlaps count, and strings are judged
    on the input. Rows that repeat an id and a text are copies of each other. Other
    columns of docs are not looked at.
    """
    rows = referenced(docs)
    n_buckets = bucket_count(docs)
    found = cut_lineage(_second_digits(_first_digits(rows, depth, digit, n_buckets), depth, n_buckets))
    ranges = found.where("ranges is not null").select("ref", "ranges")
    asked = found.where("asked is not null").select("ref", "asked")
    if not asked.isEmpty():
        ranges = ranges.unionByName(_last_digits(rows, asked, depth, n_buckets))
    joined = with_ranges(rows.select("doc_id", "ref", "text"), ranges)

    def work(batches):
        for part in blocks(batches):
            columns: list[list] = [[] for _ in RESULT]
            for doc_id, text, packed in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "ranges"))):
                spans, kept = 0, text
                if packed:
                    held = read_ranges(packed)
                    low, high = runs(covered(len(text), held[:, 0], held[:, 1]))
                    spans = len(low)
                    edges = zip([0, *high.tolist()], [*low.tolist(), len(text)])
                    kept = b"".join([text[a:b] for a, b in edges])
                digest = hashlib.sha256(kept).hexdigest()
                values = [doc_id, len(text), len(text) - len(kept), spans, digest, kept]
                for column, value in zip(columns, values):
                    column.append(value)
            yield batch(RESULT, columns)

    return joined.select("doc_id", "text", "ranges").mapInArrow(
        work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
