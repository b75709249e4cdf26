"""Encoding into the pieces of an existing SentencePiece vocabulary, and decoding.

A text is cut into the pieces with the largest sum of scores (Viterbi). The vocabulary
file holds ranks and no probabilities, so a piece scores the logarithm of a Zipf share of
its rank. Blanks become U+2581 and one is put in front, as the file asks; signs that the
vocabulary lacks, and U+2581 itself, become byte pieces, so decoding gives the very text.

No piece reaches from a word into a following blank, so words are settled one by one
and remembered. Giant documents are cut into chunks anywhere, also inside words: each
chunk yields a max-plus matrix from the state at its start (how many signs the last
piece of the chunk before reaches in) to that at its end. Matrices combine
associatively; a balanced tree of products gives the states at all borders, and every
chunk is then traced back on its own. Ties are broken by a hash of the places of cuts
inside the word, so chunks and whole texts agree.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from alarmloom.llm.shared import batch, blocks, keyed, mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Texts above so many bytes are giant; their chunks have so many signs.
GIANT_BYTES = 64 << 10
CHUNK_CHARS = 16 << 10
# Words whose pieces a task remembers, and the longest it does.
MEMO = 600_000
MEMO_CHARS = 64
BLANK = "▁"
# Stands for U+2581 of the text itself; lone surrogates occur in no text.
OWN_BLANK = "\udc81"
SCALE = 1 << 8
TIE_BITS = 52
WORD_TIE_BITS = 37
# Words that are settled together, slots of the piece tables, base of the pieces' hash.
TOGETHER = 8192
SLOT_BITS = 19
PIECE_BASE = np.uint64(0x9E3779B97F4A7C15)
PREFIX, NOTHING = -1, -2


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, int, bool]]:
    """(piece, integer score, whether it is a byte) by id; control pieces have an empty string."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = sum(1 / (r + 2.7) for r in range(1, n + 1))
    out = []
    for i in range(n):
        rank = n if model.is_byte(i) else min(n, max(1, round(-model.get_score(i))))
        score = round(SCALE * math.log(1 / (rank + 2.7) / total))
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        out.append((model.id_to_piece(i) if plain else "", score, model.is_byte(i)))
    return out


def _ties(n: int) -> list[int]:
    return (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(34)).astype(np.int64).tolist()


class Lookup:
    """Ids and scores of pieces by their hash; a few tables without collisions of their own."""

    def __init__(self, pieces: dict[str, tuple[int, int] | None]):
        hashes = []
        for piece in pieces:
            value = 0
            for sign in piece:
                value = (value * int(PIECE_BASE) + ord(sign) + 1) & (1 << 64) - 1
            hashes.append(value)
        keys = np.array(hashes, np.uint64)
        ids = np.array([PREFIX if e is None else e[0] for e in pieces.values()], np.int32)
        scores = np.array([0 if e is None else e[1] >> TIE_BITS for e in pieces.values()], np.int64)
        self.tables = []
        left = np.arange(len(keys))
        turn = 1
        while len(left):
            factor = mix(np.array([turn], np.uint64))[0] | np.uint64(1)
            slots = ((keys[left] * factor) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            first = np.unique(slots, return_index=True)[1]
            turn += 1
            if self.tables and len(first) < len(left) and turn < 1000:
                continue
            held = np.full(1 << SLOT_BITS, -1, np.int32)
            held[slots[first]] = left[first]
            self.tables.append((factor, held))
            left = np.delete(left, first)
        self.keys, self.ids, self.scores = np.append(keys, np.uint64(0)), np.append(ids, NOTHING), np.append(scores, 0)

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id of each hash and its score; PREFIX for the beginning of a piece, else NOTHING."""
        none = len(self.keys) - 1
        at = np.full(len(hashed), none, np.int64)
        for factor, held in self.tables:
            place = held[(hashed * factor) >> np.uint64(64 - SLOT_BITS)]
            right = (place >= 0) & (self.keys[place] == hashed)
            at[right] = place[right]
        return self.ids[at], self.scores[at]


class Encoder:
    """Viterbi over one vocabulary."""

    def __init__(self, entries: list[tuple[str, int, bool]]):
        self.table: dict[str, tuple[int, int] | None] = {}
        self.bytes = [0] * 256
        byte_score = 0
        for i, (piece, score, is_byte) in enumerate(entries):
            if is_byte:
                self.bytes[int(piece[3:5], 16)] = i
                byte_score = score
            elif piece:
                self.table[piece] = (i, score << TIE_BITS)
        pieces = [p for p in self.table if p]
        for piece in pieces:
            for k in range(1, len(piece)):
                self.table.setdefault(piece[:k], None)
        self.byte_score = byte_score << TIE_BITS
        self.longest = max(map(len, pieces), default=1)
        # Words can be cut apart only if no piece reaches over their ends.
        inner = any(BLANK in p.lstrip(BLANK) for p in pieces)
        breaks = "\n" if not any("\n" in p for p in pieces) else ""
        self.words = None if inner else re.compile(f"{BLANK}*[^{BLANK}{breaks}]+|{BLANK}+|\n", re.S)
        self.memo: dict[str, bytes] = {}
        self.ties = _ties(1 << 10)
        self.lookup = Lookup(self.table)

    def marked(self, text: str) -> str:
        return BLANK + text.replace(BLANK, OWN_BLANK).replace(" ", BLANK) if text else ""

    def cut(self, marked: str) -> list[str]:
        return self.words.findall(marked) if self.words else [marked] if marked else []

    def fallback(self, sign: str) -> list[int]:
        raw = BLANK.encode() if sign == OWN_BLANK else sign.encode("utf-8", "replace")
        return [self.bytes[b] for b in raw]

    def _tie(self, place: int) -> int:
        while place >= len(self.ties):
            self.ties = _ties(2 * len(self.ties))
        return self.ties[place]

    def forward(
        self, text: str, begin: dict[int, int], stop: int, offset: int = 0
    ) -> tuple[list[int | None], list[tuple[int, int] | None]]:
        """Best score of reaching each place from the given ones, and (start, id) of the last piece.

        Pieces start before `stop` and may end behind it. `offset` is the place of the text
        in its word; id -1 is a byte fallback.
        """
        n = len(text)
        best: list[int | None] = [None] * (n + 1)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for place, score in begin.items():
            best[place] = score
        table, longest = self.table, self.longest
        self._tie(offset + n)
        ties = self.ties
        for i in range(min(stop, n)):
            base = best[i]
            if base is None:
                continue
            single = False
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = text[i:j]
                if piece not in table:
                    break
                entry = table[piece]
                if entry is None:
                    continue
                single = single or j == i + 1
                score = base + entry[1] + ties[offset + j]
                held = best[j]
                if held is None or score > held:
                    best[j], last[j] = score, (i, entry[0])
            if not single:
                raw = len(self.fallback(text[i]))
                score = base + raw * self.byte_score + ties[offset + i + 1]
                held = best[i + 1]
                if held is None or score > held:
                    best[i + 1], last[i + 1] = score, (i, -1)
        return best, last

    def trace(self, text: str, last: list, begin: int, end: int) -> list[int]:
        """Ids of the pieces from one place to another."""
        back: list[list[int]] = []
        while end > begin:
            start, piece = last[end]
            back.append([piece] if piece >= 0 else self.fallback(text[start]))
            end = start
        return [i for ids in reversed(back) for i in ids]

    def word(self, word: str) -> bytes:
        """Ids of one word, as the bytes of 32-bit numbers."""
        found = self.memo.get(word)
        if found is None:
            _, last = self.forward(word, {0: 0}, len(word))
            found = np.array(self.trace(word, last, 0, len(word)), np.int32).tobytes()
        return found

    def _settle(self, words: list[str], n: int) -> None:
        """forward() and trace() of words of one length, a place at a time."""
        signs = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        signs = np.ascontiguousarray(signs.T).astype(np.uint64) + np.uint64(1)
        k = len(words)
        best = np.full((n + 1, k), np.iinfo(np.int64).min // 2, np.int64)
        start, piece = np.zeros((n + 1, k), np.int64), np.full((n + 1, k), -1, np.int32)
        best[0] = 0
        every = np.arange(k)
        for i in range(n):
            alive, hashed = every, np.zeros(k, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                hashed = hashed * PIECE_BASE + signs[j - 1, alive]
                found, score = self.lookup.find(hashed)
                total = best[i, alive] + (score << WORD_TIE_BITS) + self.ties[j]
                usable = found >= 0
                if j == i + 1 and not usable.all():
                    lost = np.flatnonzero(~usable)
                    raw = np.array([len(self.fallback(chr(int(c) - 1))) for c in signs[i, lost]], np.int64)
                    total[lost] = best[i, lost] + (raw * (self.byte_score >> TIE_BITS) << WORD_TIE_BITS) + self.ties[j]
                    usable = np.ones(k, bool)
                better = np.flatnonzero(usable & (total > best[j, alive]))
                at = alive[better]
                best[j, at], start[j, at], piece[j, at] = total[better], i, found[better]
                on = found > NOTHING
                if not on.all():
                    alive, hashed = alive[on], hashed[on]
                    if not len(alive):
                        break
        at = np.full(k, n)
        back, places = [], []
        while at.any():
            back.append(piece[at, every])
            at = start[at, every]
            places.append(at)
        ids = np.ascontiguousarray(np.array(back, np.int32).T[:, ::-1])
        origin = np.array(places).T[:, ::-1]
        # A word that reached its start earlier than others has idle steps in front.
        first = len(back) - 1 - (origin > 0).sum(axis=1)
        raw, width = ids.tobytes(), 4 * len(back)
        for r, (word, skip) in enumerate(zip(words, first.tolist())):
            self.memo[word] = raw[r * width + 4 * skip : (r + 1) * width]
        idle = np.arange(len(back)) < first[:, None]
        for r in np.flatnonzero(((ids < 0) & ~idle).any(axis=1)):
            own = zip(ids[r, first[r] :].tolist(), origin[r, first[r] :].tolist())
            full = [i for p, a in own for i in ([p] if p >= 0 else self.fallback(words[r][a]))]
            self.memo[words[r]] = np.array(full, np.int32).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = [self.cut(self.marked(t)) for t in texts]
        every = {w for words in cut for w in words}
        if len(self.memo) + len(every) > MEMO:
            self.memo.clear()
        by_length: dict[int, list[str]] = {}
        for word in every - self.memo.keys():
            by_length.setdefault(len(word), []).append(word)
        long = [w for n, group in by_length.items() if n > MEMO_CHARS for w in group]
        for word in long:
            self.memo[word] = self.word(word)
        for n, group in by_length.items():
            for low in range(0, len(group) if n <= MEMO_CHARS else 0, TOGETHER):
                self._settle(group[low : low + TOGETHER], n)
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32) for words in cut]
        for word in long:
            del self.memo[word]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text])[0]

    def score(self, word: str) -> int:
        best, _ = self.forward(word, {0: 0}, len(word))
        return best[len(word)]


def held_encoder(held: dict) -> Encoder:
    """The encoder of broadcast entries, made once per worker process."""
    if "encoder" not in held:
        held["encoder"] = Encoder(held["entries"])
    return held["encoder"]


Matrix = list[list[int | None]]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two matrices."""
    width = range(len(a))
    out: Matrix = []
    for row in a:
        reach = [k for k in width if row[k] is not None]
        out.append([max((row[k] + b[k][j] for k in reach if b[k][j] is not None), default=None) for j in width])
    return out


def border_states(matrices: list[Matrix]) -> list[int]:
    """States at all borders of the best path from state 0 to state 0, by a balanced tree of products."""

    def build(low: int, high: int):
        if high - low == 1:
            return matrices[low], None, None
        middle = (low + high) // 2
        left, right = build(low, middle), build(middle, high)
        return combine(left[0], right[0]), left, right

    states = [0] * (len(matrices) + 1)
    open_ = [(build(0, len(matrices)), 0, len(matrices))]
    while open_:
        (_, left, right), low, high = open_.pop()
        if left is None:
            continue
        middle = (low + high) // 2
        rows, columns = left[0][states[low]], right[0]
        ways = [
            (rows[k] + columns[k][states[high]], k)
            for k in range(len(columns))
            if rows[k] is not None and columns[k][states[high]] is not None
        ]
        states[middle] = max(ways)[1]
        open_ += [(left, low, middle), (right, middle, high)]
    return states


class Chunk:
    """Part of a marked text: `size` signs and what follows of the last word, to see pieces that reach out."""

    def __init__(self, encoder: Encoder, text: str, size: int, offset: int):
        self.encoder, self.text, self.size, self.offset = encoder, text, size, offset
        # The first and last word may be parts; offset counts the signs of the first that lie before.
        words = encoder.cut(text[:size])
        whole = encoder.cut(text)
        self.open_end = len(text) > size
        ends, at = [], 0
        for word in whole:
            at += len(word)
            ends.append(at)
        self.head = 0
        if offset:
            self.head = min(ends[0], size)
        self.tail = size
        if self.open_end:
            self.tail = max((e for e in ends if e <= size), default=0)
            if offset and self.tail < self.head:
                self.tail = 0
        self.single = bool(offset) and self.open_end and ends[0] > size
        del words

    def matrix(self) -> Matrix:
        e, width = self.encoder, self.encoder.longest
        out: Matrix = [[None] * width for _ in range(width)]
        if self.single:
            for k in range(min(width, self.size)):
                best, _ = e.forward(self.text, {k: 0}, self.size, self.offset)
                for j in range(min(width, len(self.text) - self.size + 1)):
                    out[k][j] = best[self.size + j]
            # A chunk shorter than what a piece reaches in is passed through.
            for k in range(self.size, width):
                out[k][k - self.size] = 0
            return out
        head: dict[int, int] = {0: 0}
        if self.head:
            head = {}
            for k in range(min(width, self.head + 1)):
                best, _ = e.forward(self.text[: self.head], {k: 0}, self.head, self.offset)
                if best[self.head] is not None:
                    head[k] = best[self.head]
        tail: dict[int, int] = {0: 0}
        if self.tail < self.size:
            best, _ = e.forward(self.text[self.tail :], {0: 0}, self.size - self.tail)
            rest = len(self.text) - self.size
            tail = {j: best[self.size - self.tail + j] for j in range(min(width, rest + 1))}
        # Words inside add the same to every path.
        for k, a in head.items():
            for j, b in tail.items():
                out[k][j] = None if b is None else a + b
        return out

    def ids(self, begin: int, end: int) -> list[int]:
        """Pieces that start in the chunk, on the path between two border states."""
        e = self.encoder
        if self.single:
            if begin >= self.size:
                return []
            _, last = e.forward(self.text, {begin: 0}, self.size, self.offset)
            return e.trace(self.text, last, begin, self.size + end)
        out: list[int] = []
        if self.head:
            part = self.text[: self.head]
            _, last = e.forward(part, {begin: 0}, self.head, self.offset)
            out += e.trace(part, last, begin, self.head)
        for word in e.cut(self.text[self.head : self.tail]):
            out += np.frombuffer(e.word(word), np.int32).tolist()
        if self.tail < self.size:
            part = self.text[self.tail :]
            _, last = e.forward(part, {0: 0}, self.size - self.tail)
            out += e.trace(part, last, 0, self.size - self.tail + end)
        return out


def chunks(encoder: Encoder, text: str, size: int = CHUNK_CHARS) -> Iterator[tuple[str, int, int]]:
    """(signs with those that follow in the last word, own signs, offset in the first word) of a text."""
    marked = encoder.marked(text)
    ends, at = [], 0
    for word in encoder.cut(marked):
        at += len(word)
        ends.append(at)
    ends = np.array(ends)
    for low in range(0, len(marked), size):
        high = min(low + size, len(marked))
        k = int(np.searchsorted(ends, low, side="right"))
        start = int(ends[k - 1]) if k else 0
        end = int(ends[np.searchsorted(ends, high, side="left")])
        yield marked[low : min(end, high + encoder.longest - 1)], high - low, low - start


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _id_lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    joined = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(joined, pa.int32()))


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and ids (array of piece ids), one row per row of docs.

    A missing or empty text has no pieces. Repeated rows each give a row; other columns
    of docs are not looked at. Giant documents go through the chunks described above.
    """
    sent = docs.sparkSession.sparkContext.broadcast({"entries": vocabulary(path)})
    source = keyed(docs)

    def short(batches):
        encoder = held_encoder(sent.value)
        for part in blocks(batches):
            ids = encoder.encode_all([t.decode("utf-8", "replace") for t in part.column("text").to_pylist()])
            lengths = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lengths, _id_lists(ids)], schema=ENCODED)

    small = F.octet_length("text") <= GIANT_BYTES
    plain = source.where(small).select("doc_id", "text").mapInArrow(short, "doc_id bigint, n_tokens bigint, ids array<int>")
    return plain.unionByName(_giant(source.where(~small), sent))


CHUNKS = pa.schema(
    [("id", pa.int64()), ("key", pa.int64()), ("no", pa.int32()), ("text", pa.binary()), ("size", pa.int32()), ("offset", pa.int32())]
)


def _giant(source: DataFrame, sent) -> DataFrame:
    def cut(batches):
        encoder = held_encoder(sent.value)
        for part in batches:
            for i, key, text in zip(*(part.column(c).to_pylist() for c in ("id", "key", "text"))):
                rows = enumerate(chunks(encoder, text.decode("utf-8", "replace")))
                for no, (signs, size, offset) in rows:
                    yield batch(CHUNKS, [[i], [key], [no], [signs.encode("utf-8", "surrogatepass")], [size], [offset]])

    def weigh(batches):
        encoder = held_encoder(sent.value)
        for part in batches:
            texts, sizes, offsets = (part.column(c).to_pylist() for c in ("text", "size", "offset"))
            found = [
                json.dumps(Chunk(encoder, t.decode("utf-8", "surrogatepass"), n, o).matrix())
                for t, n, o in zip(texts, sizes, offsets)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("key"), part.column("no"), pa.array(found)], ["id", "key", "no", "matrix"]
            )

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        states = border_states([json.loads(m) for m in table.column("matrix").to_pylist()])
        out = table.select(["id", "key", "no"])
        out = out.append_column("begin", pa.array(states[:-1], pa.int32()))
        return out.append_column("end", pa.array(states[1:], pa.int32()))

    def trace(batches):
        encoder = held_encoder(sent.value)
        for part in batches:
            columns = (part.column(c).to_pylist() for c in ("text", "size", "offset", "begin", "end"))
            ids = [
                np.array(Chunk(encoder, t.decode("utf-8", "surrogatepass"), n, o).ids(a, b), np.int32)
                for t, n, o, a, b in zip(*columns)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("key"), part.column("no"), _id_lists(ids)], ["id", "key", "no", "ids"]
            )

    once = source.select("id", "key", "text").dropDuplicates(["id", "key"])
    pieces = once.mapInArrow(cut, "id bigint, key bigint, no int, text binary, size int, offset int")
    spread = pieces.repartition("id", "key", "no")
    matrices = spread.mapInArrow(weigh, "id bigint, key bigint, no int, matrix string")
    states = matrices.groupBy("id", "key").applyInArrow(scan, "id bigint, key bigint, no int, begin int, end int")
    traced = spread.join(states, ["id", "key", "no"]).mapInArrow(trace, "id bigint, key bigint, no int, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("no", "ids")))
    whole = traced.groupBy("id", "key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    rows = source.select("doc_id", "id", "key").join(whole, ["id", "key"])
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


DECODED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("text", pa.string()),
        ("text_sha256", pa.string()),
    ]
)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, text and the digests of ids (as 32-bit numbers) and text, one row per row."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work(batches):
        raw = [
            bytes([int(p[3:5], 16)]) if is_byte else p.replace(BLANK, " ").encode() for p, _, is_byte in sent.value
        ]
        for part in batches:
            columns: list[list] = [[] for _ in DECODED]
            for doc_id, held in zip(part.column("doc_id").to_pylist(), part.column("ids")):
                ids = np.asarray(held.values, np.int32) if held.is_valid else np.empty(0, np.int32)
                text = b"".join(map(raw.__getitem__, ids.tolist()))[1:]
                digest = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                values = [doc_id, len(ids), digest, text.decode("utf-8", "replace"), hashlib.sha256(text).hexdigest()]
                for column, value in zip(columns, values):
                    column.append(value)
            yield batch(DECODED, columns)

    return encoded.select("doc_id", "ids").mapInArrow(
        work, "doc_id bigint, n_tokens bigint, ids_sha256 string, text string, text_sha256 string"
    )
