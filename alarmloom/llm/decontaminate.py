"""Benchmark decontamination with an FM-index per shard of documents.

The windows of the benchmark's items are sent to the tasks in blocks of bounded size.
Each task indexes the words of its shard, searches all windows backwards through the
wavelet matrix, locates their occurrences by stored suffix places and merges the covered
words into removal spans. Words that no item has are breaks of the index, and pieces
between breaks that are shorter than the shortest window are left out: nothing can
occur there. Documents are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alarmloom.llm.fmindex import FmIndex
from alarmloom.llm.secrets import with_length
from alarmloom.llm.shared import batch, blocks, covered, keyed, runs

WINDOW = 10
# Bytes of benchmark text that are sent to every task at a time; a larger benchmark takes several passes.
BENCHMARK_BYTES = 2 << 20
# Text of one shard, the part of a task that is indexed together.
SHARD_BYTES = 4 << 20

# Signs of words: ASCII letters and digits and all signs outside ASCII; letters become small ones.
WORDS_ONLY = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
SPANS = "array<struct<start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

class Phrases:
    """Distinct windows of a block of items, as numbers of words, by length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = text.translate(WORDS_ONLY).split()
            codes = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            size = min(window, len(codes))
            for at in range(len(codes) - size + 1 if size else 0):
                # An item without an id marks words but is not named.
                held = owners.setdefault(tuple(codes[at : at + size]), set())
                if item is not None:
                    held.add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == size]
            self.by_length[size] = (np.array(own, np.int64), [sorted(owners[p]) for p in own])
        self.least = min(self.by_length, default=0)


def _pieces(codes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of pieces of known words, with a break after each, and their places in codes."""
    known = np.zeros(len(codes) + len(bounds), bool)
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # One unknown word between documents keeps pieces inside them.
    shifted = np.arange(len(codes)) + doc_of
    known[shifted] = codes > 0
    starts, ends = runs(known)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = ends - starts + 1
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    back = np.full(len(known) + 1, -1, np.int64)
    back[shifted] = np.arange(len(codes))
    place = back[at]
    place[np.cumsum(lengths) - 1] = -1
    symbols = np.where(place >= 0, codes[np.maximum(place, 0)], 0)
    return symbols, place


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Word count, covered spans of words and occurring items of each text."""
    get = phrases.numbers.get
    split = [t.translate(WORDS_ONLY).split() for t in texts]
    sizes = [len(w) for w in split]
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    codes = np.fromiter((get(w, 0) for ws in split for w in ws), np.int64, int(bounds[-1]))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    symbols, place = _pieces(codes, bounds, phrases.least) if phrases.least else (np.empty(0, np.int64),) * 2
    if len(symbols):
        index = FmIndex(symbols)
        starts, ends = [], []
        for size, (windows, owners) in phrases.by_length.items():
            low, high = index.search(windows)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            counts = (high - low)[hit]
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[hit], counts)
            at = place[index.locate(rows)]
            starts.append(at)
            ends.append(at + size)
            docs = np.searchsorted(bounds, at, side="right") - 1
            pairs = np.unique(np.stack([docs, np.repeat(hit, counts)], axis=1), axis=0)
            for doc, window in pairs.tolist():
                items[doc].update(owners[window])
        if starts:
            hit = covered(len(codes), np.concatenate(starts), np.concatenate(ends))
            # A break between documents, as covered words of neighbours are not one span.
            doc_of = np.repeat(np.arange(len(texts)), sizes)
            marked = np.zeros(len(codes) + len(texts), bool)
            marked[np.arange(len(codes)) + doc_of] = hit
            for a, b in zip(*runs(marked)):
                doc = int(np.searchsorted(bounds[1:] + np.arange(len(texts)), a, side="right"))
                off = int(bounds[doc]) + doc
                spans[doc].append((int(a) - off, int(b) - off))
    return sizes, spans, [sorted(s) for s in items]


def _items(benchmark: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of bounded bytes; one item may be larger than a block."""
    block, held = [], 0
    rows = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    for row in rows.toLocalIterator():
        if block and held + len(row["text"]) > BENCHMARK_BYTES:
            yield block
            block, held = [], 0
        block.append((row["item"], bytes(row["text"])))
        held += len(row["text"])
    yield block


class Shards:
    """Searches the shards of a task for one block of items, adding to what earlier blocks found."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, names: tuple[str, str]):
        self.phrases = Phrases(items, window)
        self.names = names

    def of(self, part: pa.RecordBatch) -> tuple[list[bytes], list[int], list[list[tuple[int, int]]], list[list[str]]]:
        texts = [t if isinstance(t, bytes) else (t or "").encode() for t in part.column("text").to_pylist()]
        sizes, spans, items = search_shard(texts, self.phrases)
        earlier_spans, earlier_items = (part.column(n).to_pylist() for n in self.names)
        spans = [_merged([(x["start"], x["end"]) for x in old] + new) for old, new in zip(earlier_spans, spans)]
        return texts, sizes, spans, [sorted({*old, *new}) for old, new in zip(earlier_items, items)]


def _searched(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, tuple[str, str], object]:
    """docs with two more columns that hold what all blocks of items but the last have found.

    Also the names of those columns and the last block, broadcast. A benchmark within
    BENCHMARK_BYTES is one block, and the columns are still empty.
    """
    names = tuple(_free(docs, n) for n in ("spans", "items"))
    out = docs.withColumn(names[0], F.array().cast(SPANS)).withColumn(names[1], F.array().cast("array<string>"))
    sent = [docs.sparkSession.sparkContext.broadcast(items) for items in _items(benchmark)]
    schema = out.schema
    for one in sent[:-1]:

        def work(batches, one=one):
            shards = Shards(one.value, window, names)
            for part in blocks(batches, limit=SHARD_BYTES):
                _, _, spans, items = shards.of(part)
                shown = [[{"start": a, "end": b} for a, b in s] for s in spans]
                for name, values in zip(names, (shown, items)):
                    at = part.schema.get_field_index(name)
                    part = part.set_column(at, part.schema.field(at), pa.array(values, part.schema.field(at).type))
                yield part

        out = out.mapInArrow(work, schema)
    return out, names, sent[-1]


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of docs that lie in a window of the benchmark, one row per row of docs.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (maximal
    spans of covered words, half-open) and items (sorted as strings). A missing text has
    no words, and an item without words no windows. An item without an id marks words but
    is not counted. Other columns of either table are not looked at.
    """
    source, names, last = _searched(keyed(docs).select("doc_id", "text"), benchmark, window)

    def work(batches):
        shards = Shards(last.value, window, names)
        for part in blocks(batches, limit=SHARD_BYTES):
            _, sizes, spans, items = shards.of(part)
            hits = [sum(b - a for a, b in s) for s in spans]
            digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
            shown = [[{"start": a, "end": b} for a, b in s] for s in spans]
            columns = [part.column("doc_id"), sizes, hits, [len(i) for i in items], digests]
            yield batch(RESULT, [*columns, [n > 0 for n in hits], shown, items])

    return source.mapInArrow(
        work,
        "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
        f"spans {SPANS}, items array<string>",
    )


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("spans", SPAN_TYPE),
        ("items", pa.list_(pa.string())),
    ]
)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    plain = np.frombuffer(text.translate(WORDS_ONLY), np.uint8) != 32
    starts, ends = runs(plain)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the words that lie in a window of the benchmark.

    All rows and columns stay; n_chars follows the text if there is such a column, and
    texts without a hit stay as they are. Windows are judged on the input.
    """
    source, names, last = _searched(docs, benchmark, window)

    def work(batches):
        shards = Shards(last.value, window, names)
        for part in blocks(batches, limit=SHARD_BYTES):
            texts, _, spans, _ = shards.of(part)
            old = part.column("text").to_pylist()
            new = [cut_spans(r, s).decode() if s else t for t, r, s in zip(old, texts, spans)]
            at = part.schema.get_field_index("text")
            part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
            yield part.drop_columns(list(names))

    return with_length(source.mapInArrow(work, docs.schema))
