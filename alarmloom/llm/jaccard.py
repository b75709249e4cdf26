"""Exact Jaccard join of documents on word shingles.

Every set is cut into segments by hashing its members; the number of segments depends on
the band of its size. Sets of a pair above the threshold differ in few members, so by
the pigeonhole principle they agree on a segment, or differ by one member on a segment
that is indexed with its one-deletion neighbours too. A set spends its allowance where
matches are cheap: as many of its smallest segments as the reserve segments (those with
neighbours) make up for are skipped as probes, since small segments are shared by chance.
What meets is verified on the texts, unless maps of the sets' parities rule a link out.

Documents with equal sets are one node. Signatures that many nodes share are not
expanded into pairs: their members are held against the member that shares most. Of what is
then still in different components, the maps are held against each other: where most members
are probes all of a family of crowds, and else the few probes against their own crowd, both in
blocks of bounded size. The pairs that the maps leave over are verified on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from alarmloom.llm.components import components
from alarmloom.llm.shared import NO_ID, ODD, WordHashes, blocks, bucket_count, by_bucket, keyed, mix, pack, released, shingles, unpack
from alarmloom.operators.sizing import cut_lineage, small_side

# Nodes that may share a signature and still be paired off directly.
CROWD = 24
# Text that one task prepares together.
JOIN_BLOCK = 6 << 20
# Nodes and shingles of a block when the maps of families of crowds are compared.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 22
# Probes and members of a crowd that meet in one task, and shingles of a set whose map travels to its crowds.
PROBES, MEMBERS, MAPPED = 4096, 16384, 4096
# Partners of a node that one lot of the verification holds.
LOT = 256
SIZES = 1 << 31
PROBE, DELETED = 1, 2

# Least bits of a set's parity map; larger sets have two to four bits a member.
MAP_BITS = 1024
NODES_SQL = "doc_id bigint, id bigint, key bigint, n_shingles bigint, node bigint, bits binary"
NODES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("id", pa.int64()),
        ("key", pa.int64()),
        ("n_shingles", pa.int64()),
        ("node", pa.int64()),
        ("bits", pa.binary()),
    ]
)
PACKED = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])
MET_SQL = "a bigint, b bigint, crowd bigint, size int, flags int"
MET = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("crowd", pa.int64()), ("size", pa.int32()), ("flags", pa.int32())]
)

BLOCKS_SQL = "family bigint, block bigint, packed binary"


class Rule:
    """Bands of sizes for the threshold part / whole, and the segments of each band."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole
        lows, low = [], 1
        while low < SIZES:
            lows.append(low)
            low = max(low, low * whole // part) + 1
        self.lows = np.array(lows, np.int64)
        highs = np.append(self.lows[1:] - 1, SIZES)
        # Members in which two sets may differ if the smaller one is in the band.
        apart = (whole - part) * (highs + whole * highs // part) // (whole + part)
        self.segments = np.where(apart > 0, apart + 1, 0)
        mean = highs / np.maximum(1, self.segments)
        share = np.exp(-mean) * (1 + mean)
        self.reserve = np.minimum(self.segments, np.ceil(self.segments * share).astype(np.int64))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.whole * shared >= self.part * (a + b - shared)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can be linked at all."""
        return self.part * np.maximum(a, b) <= self.whole * np.minimum(a, b)


def sets(texts: list[bytes], hashes: WordHashes, size: int) -> list[np.ndarray]:
    """Sorted hashes of the shingles of each text, lower-cased; a short text is one shingle."""
    split = [t.lower().split() for t in texts]
    words = hashes.of([w for ws in split for w in ws])
    every = shingles(words, size)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= size:
            out.append(np.unique(every[at : at + n - size + 1]))
        else:
            out.append(shingles(words[at : at + n], n) if n else every[:0])
        at += n
    return out


def digest(members: np.ndarray) -> int:
    """Name of a set: 64 bits, signed."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def parity(members: np.ndarray) -> bytes:
    """Map of bits, each the parity of the members that hash to it.

    A member more or less flips one bit, so two sets differ in as many members as bits at
    least. The bits grow with the set, in powers of two, so that the map never fills up.
    """
    n = max(MAP_BITS, 1 << (2 * len(members) - 1).bit_length())
    odd = np.bincount((mix(members) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def flipped(one: bytes, other: bytes) -> int:
    """Bits in which two parity maps differ; the longer one is folded to the bits of the shorter."""
    short, long_ = sorted((np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)), key=len)
    folded = np.bitwise_xor.reduce(long_.reshape(-1, len(short)), axis=0)
    return int(np.bitwise_count(short ^ folded).sum())


def signatures(members: list[np.ndarray], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(signature, index of the set, flags) of all sets, for each band that a partner may be in."""
    sizes = np.array([len(m) for m in members], np.int64)
    if not sizes.sum():
        return
    tokens = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    own = rule.band(sizes)
    first = rule.band(np.maximum(1, -(-rule.part * sizes // rule.whole)))
    for back in range(int((own - first).max()) + 1):
        band = np.maximum(own - back, 0)
        count = np.where((sizes > 0) & (own - back >= first), rule.segments[band], 0)
        if not count.any():
            continue
        offset = np.cumsum(count) - count
        keep = count[owner] > 0
        doc, token = owner[keep], tokens[keep]
        salt = band.astype(np.uint64) * ODD
        spread = mix(token ^ salt[doc])
        segment = (spread % count[doc].astype(np.uint64)).astype(np.int64)
        slot = offset[doc] + segment
        total = int(count.sum())
        value = mix(spread)
        # Sums of hashes, by halves: exact in a double, and equal for equal segments.
        low = np.bincount(slot, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total)
        high = np.bincount(slot, weights=(value >> np.uint64(32)).astype(np.float64), minlength=total)
        sums = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
        held = np.bincount(slot, minlength=total)
        slot_doc = np.repeat(np.arange(len(members)), count)
        slot_segment = np.arange(total) - np.repeat(offset, count)
        # Mixed, else empty segments of different bands would have one name.
        names = mix((slot_segment.astype(np.uint64) + np.uint64(1)) * ODD + mix(salt)[slot_doc])
        reserve = slot_segment < rule.reserve[band][slot_doc]
        # The smallest segments are no probes, up to what the reserve makes up for.
        order = np.lexsort((held, slot_doc))
        spent = np.cumsum(np.where(reserve, 2, 1)[order])
        before = np.concatenate(([0], spent))[offset[slot_doc[order]]]
        skipped = np.zeros(total, bool)
        skipped[order] = spent - before <= rule.reserve[band][slot_doc[order]]
        flags = np.where(skipped, 0, PROBE).astype(np.uint8)
        yield mix(sums + names), slot_doc, flags
        gone = reserve[slot]
        if gone.any():
            at = slot[gone]
            yield mix(sums[at] - value[gone] + names[at]), doc[gone], flags[at] | np.uint8(DELETED)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """Size and node of every document."""

    def work(batches):
        hashes = WordHashes()
        for part in blocks(batches, limit=JOIN_BLOCK):
            found = sets(part.column("text").to_pylist(), hashes, size)
            lengths = pa.array([len(m) for m in found], pa.int64())
            nodes = pa.array([digest(m) if len(m) else None for m in found], pa.int64())
            bits = pa.array([parity(m) if len(m) else None for m in found], pa.binary())
            columns = [part.column("doc_id"), part.column("id"), part.column("key"), lengths, nodes, bits]
            yield pa.RecordBatch.from_arrays(columns, schema=NODES)

    return docs.mapInArrow(released(work), NODES_SQL)


def _spread(docs: DataFrame, size: int, rule: Rule, n_buckets: int) -> DataFrame:
    """Signatures packed by bucket; a set that a block holds twice is sent once."""

    def work(batches):
        hashes = WordHashes()
        for part in blocks(batches, limit=JOIN_BLOCK):
            once = {digest(m): m for m in sets(part.column("text").to_pylist(), hashes, size) if len(m)}
            names = np.array(list(once), np.int64)
            members = list(once.values())
            sizes = np.array([len(m) for m in members], np.int32)
            found = list(signatures(members, rule))
            if not found:
                continue
            value, owner, flags = (np.concatenate(x) for x in zip(*found))
            bucket = ((value >> np.uint64(48)) * np.uint64(n_buckets) >> np.uint64(16)).astype(np.int64)
            rows: list[list] = [[], []]
            for b, at in by_bucket(bucket):
                used, place = np.unique(owner[at], return_inverse=True)
                own = value[at]
                rows[0].append(b)
                rows[1].append(
                    pack(
                        (own & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                        (own >> np.uint64(32)).astype(np.uint16),
                        place.astype(np.uint32),
                        flags[at],
                        names[used],
                        sizes[used],
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], schema=PACKED)

    return docs.select("text").mapInArrow(released(work), "bucket bigint, packed binary")


def meet(value: np.ndarray, node: np.ndarray, size: np.ndarray, flags: np.ndarray, rule: Rule, crowd: int):
    """Candidate pairs of nodes that share a signature, and the members of crowded signatures."""
    order = np.lexsort((flags, node, value))
    value, node, size, flags = value[order], node[order], size[order], flags[order]
    same = (value[1:] == value[:-1]) & (node[1:] == node[:-1]) & (flags[1:] == flags[:-1])
    once = np.concatenate(([True], ~same)) if len(value) else np.zeros(0, bool)
    value, node, size, flags = value[once], node[once], size[once], flags[once]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(value)))
    group_size = np.repeat(counts, counts)
    a, b = [], []
    few = (group_size > 1) & (group_size <= crowd)
    for step in range(1, crowd):
        at = np.flatnonzero(few[:-step] & (value[step:] == value[:-step])) if len(value) > step else np.zeros(0, np.int64)
        if not len(at):
            break
        to = at + step
        ok = allowed(flags[at], flags[to]) & (node[at] != node[to]) & rule.near(size[at], size[to])
        a.append(node[at[ok]])
        b.append(node[to[ok]])
    many = np.flatnonzero(group_size > crowd)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.empty((0, 2), np.int64)
    return pairs, (value[many].view(np.int64), node[many], size[many], flags[many])


def allowed(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A match needs a probe, and at most one side with a member left out."""
    return ((one | other) & PROBE > 0) & (one & other & DELETED == 0)


def _meetings(packed: DataFrame, rule: Rule) -> DataFrame:
    """Pairs a, b of nodes that met, and rows with a crowd and no b for crowded signatures."""

    def work(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [unpack(x, np.uint32, np.uint16, np.uint32, np.uint8, np.int64, np.int32) for x in table.column("packed").to_pylist()]
        low, high, place, flags, names, sizes = zip(*parts)
        value = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
        node = np.concatenate([n[p] for n, p in zip(names, place)])
        size = np.concatenate([n[p] for n, p in zip(sizes, place)]).astype(np.int64)
        pairs, (crowd, member, sizes_of, flags_of) = meet(value, node, size, np.concatenate(flags), rule, CROWD)
        salt = mix(np.array([bucket + 1], np.uint64))
        crowd = mix(crowd.view(np.uint64) ^ salt).view(np.int64)
        n, k = len(pairs), len(crowd)
        return pa.table(
            [
                np.concatenate([pairs[:, 0], member]),
                pa.array(np.concatenate([pairs[:, 1], np.zeros(k, np.int64)]), mask=np.arange(n + k) >= n),
                pa.array(np.concatenate([np.zeros(n, np.int64), crowd]), mask=np.arange(n + k) < n),
                np.concatenate([np.zeros(n, np.int32), sizes_of.astype(np.int32)]),
                np.concatenate([np.zeros(n, np.int32), flags_of.astype(np.int32)]),
            ],
            schema=MET,
        )

    return packed.groupBy("bucket").applyInArrow(work, MET_SQL)


def _possible(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose parity maps do not rule a link out; no linked pair is lost."""
    facts = members.where("node is not null").groupBy("node")
    facts = facts.agg(F.any_value("bits").alias("bits"), F.max("n_shingles").alias("n"))

    def of(name: str) -> DataFrame:
        return facts.select(F.col("node").alias(name), F.col("bits").alias(f"bits_{name}"), F.col("n").alias(f"n_{name}"))

    near = F.lit(rule.part) * F.greatest("n_a", "n_b") <= F.lit(rule.whole) * F.least("n_a", "n_b")
    sizes = facts.select("node", "n")
    for name in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}")), name)
    both = pairs.where(near).select("a", "b").join(of("a"), "a").join(of("b"), "b")

    def work(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            maps = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            apart = np.fromiter((flipped(x, y) for x, y in maps), np.int64, len(a))
            keep = (rule.whole + rule.part) * apart <= (rule.whole - rule.part) * (n_a + n_b)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return both.mapInArrow(released(work), "a bigint, b bigint")


def _linked(tried: DataFrame, members: DataFrame, docs: DataFrame, size: int, rule: Rule) -> DataFrame:
    """The components of all linked pairs.

    First every node is held against its smallest partner only; of the other pairs, those
    that are in one component by then need no look.
    """
    first = tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut_lineage(_verified(first, members, docs, size, rule))
    roots = components(links)
    rest = tried.join(first, ["a", "b"], "left_anti")
    for name in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}")), name, "left")
    rest = rest.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    more = cut_lineage(_verified(cut_lineage(rest), members, docs, size, rule))
    if more.isEmpty():
        return roots
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(more.select("a", "b")))


def _compressed(rows: DataFrame) -> DataFrame:
    """The rows with their text compressed, for the way through a shuffle."""

    def work(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for part in blocks(batches):
            packed = pa.array([press(x) for x in part.column("text").to_pylist()], pa.binary())
            yield part.set_column(part.schema.get_field_index("text"), "text", packed)

    return rows.mapInArrow(released(work), rows.schema)


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, size: int, rule: Rule) -> DataFrame:
    """The pairs that are linked, counted on the shingles of one text of each node.

    A text goes straight from the scan to the node a that it is held against, compressed,
    and no pair carries two. The partners of a node are dealt in lots, so that a node with
    many is no hot key; its own text goes to each lot.
    """
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    own = lots.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("lot"))
    dealt = pairs.join(lots, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("lots")).alias("lot"))
    one = members.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "key")).alias("at"))
    placed = own.unionByName(dealt).join(one, "node").select("a", "lot", "node", "at.id", "at.key")
    rows = docs.select("id", "key", "text").join(small_side(cut_lineage(placed)), ["id", "key"]).select("a", "lot", "node", "text")

    def work(batches):
        open_, at, mine = zstandard.ZstdDecompressor().decompress, None, None
        for part in blocks(batches):
            hashes = WordHashes()
            out: list[list[int]] = [[], []]
            for a, lot, node, packed in zip(*(part.column(c).to_pylist() for c in ("a", "lot", "node", "text"))):
                if node == a:
                    if at != (a, lot):
                        at, mine = (a, lot), sets([open_(packed)], hashes, size)[0]
                    continue
                other = sets([open_(packed)], hashes, size)[0]
                common = len(np.intersect1d(mine, other, assume_unique=True))
                if rule.linked(common, len(mine), len(other)):
                    out[0].append(a)
                    out[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    # A node's own text comes first in each of its lots.
    ordered = _compressed(rows).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("node") != F.col("a"))
    return ordered.mapInArrow(released(work), "a bigint, b bigint").distinct()


def _block(table: pa.Table) -> pa.Table:
    """One row of a block: its nodes, their roots, sizes and parity maps."""
    maps = table.column("bits").to_pylist()
    columns = [table.column(c).to_numpy() for c in ("node", "root", "n_shingles")]
    packed = pack(*columns, np.array([len(m) for m in maps], np.int64), b"".join(maps))
    first = table.slice(0, 1).select(["family", "block"])
    return first.append_column("packed", pa.array([packed], pa.binary()))


def _by_length(sizes: np.ndarray, lengths: np.ndarray, joined: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length of a map that occurs, the indexes of its nodes by size, and their maps as rows."""
    ends = np.cumsum(lengths)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        at = at[np.argsort(sizes[at], kind="stable")]
        maps = [np.frombuffer(joined, np.uint64, length // 8, ends[i] - length) for i in at] if length else np.empty((len(at), 0), np.uint64)
        yield at, np.stack(maps)


def _not_ruled_out(n_a: np.ndarray, maps_a: tuple, n_b: np.ndarray, maps_b: tuple, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """Index of a set, and indexes of the others whose size and parity map do not rule a link out.

    Maps are the lengths and the bytes of all; a set without a map is ruled out by its size only.
    """
    right = list(_by_length(n_b, *maps_b))
    for at_a, rows in _by_length(n_a, *maps_a):
        for at_b, columns in right:
            width = min(rows.shape[1], columns.shape[1])
            if width:
                left, against = (np.bitwise_xor.reduce(x.reshape(len(x), -1, width), axis=1) for x in (rows, columns))
            else:
                left, against = rows[:, :0], columns[:, :0]
            sizes = n_b[at_b]
            low = np.searchsorted(sizes, -(-rule.part * n_a[at_a] // rule.whole))
            high = np.searchsorted(sizes, rule.whole * n_a[at_a] // rule.part, side="right")
            for i, bits, start, end in zip(at_a.tolist(), left, low.tolist(), high.tolist()):
                if start >= end:
                    continue
                apart = np.bitwise_count(against[start:end] ^ bits).sum(axis=1, dtype=np.int64)
                held = (rule.whole + rule.part) * apart <= (rule.whole - rule.part) * (n_a[i] + sizes[start:end])
                yield i, at_b[start:end][held]


def possible_across(one: bytes, other: bytes, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of two blocks, in different components, whose parity maps do not rule a link out."""
    (node_a, root_a, n_a, *maps_a), (node_b, root_b, n_b, *maps_b) = (
        unpack(x, np.int64, np.int64, np.int64, np.int64, None) for x in (one, other)
    )
    out: list[list[np.ndarray]] = [[], []]
    for i, j in _not_ruled_out(n_a, maps_a, n_b, maps_b, rule):
        j = j[root_b[j] != root_a[i]]
        if len(j):
            out[0].append(np.minimum(node_a[i], node_b[j]))
            out[1].append(np.maximum(node_a[i], node_b[j]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in out)


def possible_probed(table: pa.Table, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an asking row and another of its crowd that match, are in different components and may be linked."""
    node, root, size, flags, asks = (table.column(c).to_numpy() for c in ("node", "root", "size", "flags", "asks"))
    maps = [m or b"" for m in table.column("bits").to_pylist()]
    sides = []
    for at in (np.flatnonzero(asks), np.flatnonzero(~asks)):
        own = [maps[i] for i in at.tolist()]
        sides.append((at, size[at].astype(np.int64), (np.array([len(m) for m in own], np.int64), b"".join(own))))
    (at_a, n_a, maps_a), (at_b, n_b, maps_b) = sides
    out: list[list[np.ndarray]] = [[], []]
    for i, j in _not_ruled_out(n_a, maps_a, n_b, maps_b, rule):
        one, others = at_a[i], at_b[j]
        others = others[allowed(flags[one], flags[others]) & (root[others] != root[one])]
        if len(others):
            out[0].append(np.minimum(node[one], node[others]))
            out[1].append(np.maximum(node[one], node[others]))
    none = np.empty(0, np.int64)
    return tuple(np.unique(np.stack([np.concatenate(x) for x in out]), axis=1)) if out[0] else (none, none)


def _probed(crowds: DataFrame, roots: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of a crowd with a probe, in different components so far, that may be linked.

    A match needs a probe, and most members of a crowd are none: it is a segment of few members
    that they do not ask for. So only the probes are held against the members, in lots of
    about PROBES against blocks of about MEMBERS. Maps of sets above MAPPED shingles stay
    behind; their pairs, which are few, are left to what tries pairs.
    """
    placed = crowds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    probe = F.col("flags").bitwiseAND(F.lit(PROBE)) > 0
    facts = placed.groupBy("crowd").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.ceil(F.count_if(probe) / PROBES).alias("lots"),
        F.ceil(F.count("*") / MEMBERS).alias("blocks"),
        F.count_if(F.col("flags") == PROBE).alias("whole"),
    )
    facts = facts.where("low <> high and lots > 0").drop("low", "high")
    # Without a probe that is whole, a set with a member left out that is no probe matches none.
    rows = placed.join(facts, "crowd").where((F.col("whole") > 0) | (F.col("flags") != DELETED))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    def one_of(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n))

    kept = ["crowd", "node", "root", "size", "flags"]
    asking = rows.where(probe).select(*kept, one_of("lots").alias("lot"), every("blocks").alias("block"), F.lit(True).alias("asks"))
    asked = rows.select(*kept, every("lots").alias("lot"), one_of("blocks").alias("block"), F.lit(False).alias("asks"))
    maps = members.where(F.col("n_shingles") <= MAPPED).where("node is not null").groupBy("node").agg(F.any_value("bits").alias("bits"))
    dealt = asking.unionByName(asked).join(maps, "node", "left")

    def work(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(c, pa.int64()) for c in possible_probed(table, rule)], names=["a", "b"])

    return dealt.groupBy("crowd", "lot", "block").applyInArrow(work, "a bigint, b bigint").distinct()


def _across(crowds: DataFrame, hubs: DataFrame, roots: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of nodes of a family of crowds that are in different components so far and may be linked.

    This is for crowds of many probes. Crowds that still have several components are joined to families by their hubs. A
    family's largest component is not held against itself; of all other nodes the parity maps
    are held against all of the same band of sizes and its neighbours, in blocks of at most
    about BLOCK nodes of one band. Each pair of blocks is a group of its own.
    """
    placed = crowds.select("crowd", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("crowd").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    joined = placed.join(mixed.select("crowd"), "crowd").join(hubs, "crowd")
    family = components(joined.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    known = family.withColumnRenamed("root", "family").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = members.where("node is not null").groupBy("node")
    held = held.agg(F.max("n_shingles").alias("n_shingles"), F.any_value("bits").alias("bits"))
    known = cut_lineage(known.join(held.drop("bits"), "node"))
    by_root = known.groupBy("family", "root").agg(F.count("*").alias("n"))
    top = by_root.groupBy("family").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"))
    main = top.where("roots > 1").select("family", F.col("top.root").alias("main"))
    lows = [int(x) for x in rule.lows]
    band = F.expr(f"array_size(filter(array({', '.join(f'{x}L' for x in lows)}), low -> low <= n_shingles)) - 1").cast("bigint")
    spread = known.join(main, "family").withColumn("band", band).withColumn("is_main", F.col("root") == F.col("main"))
    sizes = spread.groupBy("family", "band", "is_main").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks")
    )
    # Blocks from 0 on hold the rest of a family, those below 0 its largest component.
    block = F.pmod(F.xxhash64("node"), F.col("blocks")) * len(lows) + F.col("band")
    block = F.when(F.col("is_main"), -1 - block).otherwise(block).cast("bigint").alias("block")
    blocked = spread.join(sizes, ["family", "band", "is_main"]).select("family", "node", "root", "n_shingles", block)
    packed = blocked.join(held.select("node", "bits"), "node").groupBy("family", "block").applyInArrow(_block, BLOCKS_SQL)
    packed = cut_lineage(packed)
    # Sets of a pair are in one band or in neighbours.
    ids = packed.select("family", "block", F.expr(f"if(block < 0, -1 - block, block) % {len(lows)}").alias("band"))
    near = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band")
    others = ids.select("family", near, F.col("block").alias("other"))
    meets = ids.join(others, ["family", "band"]).where("block >= 0 or other >= 0").select("family", "block", "other")
    rows = packed.join(small_side(cut_lineage(meets)), ["family", "block"])
    rows = rows.select("family", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "packed")

    def work(table: pa.Table) -> pa.Table:
        one = table.column("one")[0].as_py()
        blobs = dict(zip(table.column("block").to_pylist(), table.column("packed").to_pylist()))
        other = next((x for b, x in blobs.items() if b != one), blobs[one])
        return pa.table([pa.array(c, pa.int64()) for c in possible_across(blobs[one], other, rule)], names=["a", "b"])

    return rows.groupBy("family", "one", "two").applyInArrow(work, "a bigint, b bigint").distinct()


def classes(source: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """doc_id, id, key, n_shingles, node and root (the name of the component) of keyed documents."""
    rule = Rule(part, whole)
    members = cut_lineage(_scan(source, size))
    met = cut_lineage(_meetings(_spread(source, size, rule, bucket_count(source)), rule))
    crowds = met.where("crowd is not null").select("crowd", F.col("a").alias("node"), "size", "flags")
    degree = crowds.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = (
        crowds.join(degree, "node")
        .groupBy("crowd")
        .agg(F.max(F.struct("degree", "node")).alias("top"))
        .select("crowd", F.col("top.node").alias("hub"))
    )
    stars = crowds.join(hubs, "crowd").where("node <> hub")
    stars = stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    direct = met.where("crowd is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = cut_lineage(_possible(direct.unionByName(stars).distinct(), members, rule))
    roots = _linked(tried, members, source, size, rule)
    if not crowds.isEmpty():
        probes = F.count_if(F.col("flags").bitwiseAND(F.lit(PROBE)) > 0)
        many = cut_lineage(crowds.groupBy("crowd").agg((2 * probes > F.count("*")).alias("many")))
        dense, sparse = (crowds.join(many.where(F.col("many") == x).select("crowd"), "crowd") for x in (True, False))
        across = _across(dense, hubs, roots, members, rule).unionByName(_probed(sparse, roots, members, rule)).distinct()
        # What has been tried and is in different components is not linked.
        left = cut_lineage(across.join(tried, ["a", "b"], "left_anti"))
        if not left.isEmpty():
            more = _linked(left, members, source, size, rule)
            roots = components(roots.unionByName(more).select(F.col("node").alias("a"), F.col("root").alias("b")))
    return members.drop("bits").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def join(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """Documents with the component of their links, one row per row of docs.

    Two documents are linked if whole * |intersection| >= part * |union| of their sets of
    `size`-word shingles. Columns: doc_id, n_shingles and component_id, the smallest
    doc_id reachable by links. A text without words is linked with nothing, and a shorter
    text than a shingle is one shingle. A row without a doc_id takes part, but names no
    component. Other columns of docs are not looked at. Links inside crowds of texts that
    share much are counted by their component and not one by one, so there is no column
    with their number.
    """
    named = classes(keyed(docs), size, part, whole)
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "root", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The rows of docs that stay when one document of each component does: the smallest doc_id.

    All columns stay. Of rows that repeat an id and a text, one stays; of rows without a
    doc_id, those stay whose component has no other row. Texts without words all stay.
    """
    own = {c.lower() for c in docs.columns}
    row_id, row_key = (next(n for n in (name, "_" + name, "__" + name) if n not in own) for name in ("id", "key"))
    found = cut_lineage(classes(keyed(docs), size, part, whole).where("node is not null").select("id", "key", "root"))
    first = found.groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    gone = found.join(first, "root").where("struct(id, key) <> first").select("id", "key").distinct()
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn(row_id, F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint")).withColumn(row_key, key)
    gone = gone.withColumnsRenamed({"id": row_id, "key": row_key})
    kept = rows.join(gone, [row_id, row_key], "left_anti")
    if not found.groupBy("id", "key").count().where("count > 1").isEmpty():
        blank = F.coalesce(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""), F.lit("")) == ""
        kept = kept.where(~blank).dropDuplicates([row_id, row_key]).unionByName(kept.where(blank))
    return kept.select(*docs.columns)
