"""The join against all pairs, its signatures against the pigeonhole principle, components against union-find."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_tables import as_rows, awkward, empty, lowered, texts_of, words

from alarmloom.llm import jaccard
from alarmloom.llm.components import components
from alarmloom.llm.shared import WordHashes


def shingle_set(text, size):
    w = words(lowered(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, part):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    own = [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]
    return sorted(((d, len(s), c) for (d, _), s, c in zip(rows, sets, own)), key=repr)


def variants(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(1000)}"
        out.append(" ".join(own[rng.randrange(3) :]))
    return out


@pytest.mark.parametrize("size,part", [(3, 90), (5, 80)])
@pytest.mark.parametrize("crowd", [2, 24])
def test_join_finds_the_components_of_all_pairs(spark, monkeypatch, size, part, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    docs = awkward(spark, extra=variants(30, 1))
    found = jaccard.join(docs, size, part)
    assert as_rows(found, "doc_id", "n_shingles", "component_id") == brute(texts_of(docs), size, part)


def test_clashing_columns_and_empty_tables(spark):
    plain = as_rows(jaccard.join(awkward(spark)), "doc_id", "n_shingles", "component_id")
    assert as_rows(jaccard.join(awkward(spark, clashing=True)), "doc_id", "n_shingles", "component_id") == plain
    assert jaccard.join(empty(spark)).collect() == []


@pytest.mark.parametrize("part", [80, 90])
def test_linked_sets_always_share_a_signature(part):
    rng, rule, hashes, seen = random.Random(part), jaccard.Rule(part, 100), WordHashes(), 0
    for _ in range(800):
        n = rng.choice([3, 5, 8, 12, 20, 60, 200])
        one = [b"%d" % rng.randrange(10**6) for _ in range(n)]
        other = list(one)
        for _ in range(rng.randrange(0, max(2, n * (100 - part) // 200))):
            i = rng.randrange(len(other))
            other[i : i + rng.randrange(2)] = [b"x%d" % rng.randrange(10**6)] * rng.randrange(2)
            other = other or [b"y"]
        a, b = jaccard.sets([b" ".join(one), b" ".join(other)], hashes, 1)
        if jaccard.digest(a) == jaccard.digest(b) or not rule.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        seen += 1
        value, owner, flags = (np.concatenate(x) for x in zip(*jaccard.signatures([a, b], rule)))
        by_value = {}
        for v, o, f in zip(value.tolist(), owner.tolist(), flags.tolist()):
            by_value.setdefault(v, []).append((o, f))
        assert any(
            x[0] != y[0] and (x[1] | y[1]) & jaccard.PROBE and not x[1] & y[1] & jaccard.DELETED
            for group in by_value.values()
            for x, y in combinations(group, 2)
        )
    assert seen > 100


def test_one_document_of_each_group_stays(spark):
    docs = awkward(spark, extra=variants(6, 2))
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    rows = texts_of(docs)
    component = {}
    for (doc_id, _, c), (d, t) in zip(brute(rows, 5, 80), sorted(rows, key=repr)):
        component[doc_id] = c
    with_words = sorted({c for (d, t) in rows if words(t) for c in [component.get(d)] if c is not None})
    held = sorted(d for d, t in texts_of(kept) if words(t) and d is not None)
    assert held == with_words
    assert sum(not words(t) for _, t in texts_of(kept)) == sum(not words(t) for _, t in rows)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 200)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    roots = dict(as_rows(found, "node", "root"))
    assert {roots[i] for i in range(41)} == {0}
    assert {roots[i] for i in range(100, 140)} == {100}
    assert roots[300] == 200


def test_parity_maps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for _ in range(50):
        one = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate((one[rng.random(len(one)) > 0.1], rng.integers(0, 1 << 63, 20).astype(np.uint64))))
        apart = len(np.setxor1d(one, other))
        flipped = jaccard.flipped(jaccard.parity(one), jaccard.parity(other))
        assert flipped <= apart


def test_parity_maps_never_exceed_the_difference():
    random = np.random.default_rng(5)
    for n, gone, more in ((10, 1, 2), (500, 40, 90), (3000, 0, 1500), (5000, 2000, 900)):
        own = random.integers(0, 1 << 63, n + more, dtype=np.uint64)
        one, other = own[:n], own[gone:]
        apart = jaccard.flipped(jaccard.parity(one), jaccard.parity(other))
        assert apart <= gone + more and apart % 2 == (gone + more) % 2
        assert apart >= (gone + more) / 4
    assert jaccard.flipped(jaccard.parity(one), jaccard.parity(one)) == 0


@pytest.mark.parametrize("part", [80, 90])
def test_maps_of_blocks_keep_all_linked_pairs_and_rule_out_far_ones(part):
    """Blocks of a family travel as parity maps, not as texts; sizes reach over several lengths of maps."""
    rng, rule = np.random.default_rng(part), jaccard.Rule(part, 100)
    groups = []
    for n in (3, 40, 500, 510, 560, 1000, 1100, 5000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for gone in (0, n // 50, n // 11, n // 5, n // 2):
            more = rng.integers(0, 1 << 63, gone // 2, dtype=np.uint64)
            groups.append(np.unique(np.concatenate((base[gone:], more))))
    groups = list({jaccard.digest(m): m for m in groups}.values())
    rows = [(jaccard.digest(m), i % 3, len(m), jaccard.parity(m)) for i, m in enumerate(groups)]

    def block(own):
        columns = zip(*([*r, 1, 0, 1, 1] for r in own))
        names = ["node", "root", "n_shingles", "bits", "family", "block", "rest_blocks", "main_blocks"]
        return jaccard._block(pa.table(dict(zip(names, map(list, columns)))))["packed"][0].as_py()

    one, other = rows[::2], rows[1::2]
    found = set(zip(*(x.tolist() for x in jaccard.possible_across(block(one), block(other), rule))))
    same = set(zip(*(x.tolist() for x in jaccard.possible_across(block(rows), block(rows), rule))))
    held = {r[0]: set(m.tolist()) for r, m in zip(rows, groups)}
    root = {r[0]: r[1] for r in rows}
    pairs = {(min(a, b), max(a, b)) for a in held for b in held if root[a] != root[b]}
    share = {p: len(held[p[0]] & held[p[1]]) / len(held[p[0]] | held[p[1]]) for p in pairs}
    linked = {p for p in pairs if share[p] >= part / 100 - 1e-12}
    crossing = {(min(a[0], b[0]), max(a[0], b[0])) for a in one for b in other}
    assert linked and linked <= same <= pairs
    assert linked & crossing == found & linked and found == same & crossing
    assert all(share[p] > 0.4 for p in same if min(len(held[x]) for x in p) > 30)


def test_blocks_meet_only_where_sizes_are_near(spark, monkeypatch):
    """Maps of a family are sent to blocks of their band of sizes and its neighbours, and lose no linked pair."""
    rng, rule = np.random.default_rng(8), jaccard.Rule(80, 100)
    groups = []
    for n in range(20, 2000, 60):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        groups += [np.unique(np.concatenate((base[gone:], base[:gone] + np.uint64(1)))) for gone in (0, n // 20, n // 2)]
    held = {jaccard.digest(m): m for m in groups}
    hub = min(held)
    members = spark.createDataFrame(
        [(k, len(m), bytearray(jaccard.parity(m))) for k, m in held.items()], "node long, n_shingles long, bits binary"
    )
    crowds = spark.createDataFrame([(1, k) for k in held], "crowd long, node long")
    hubs = spark.createDataFrame([(1, hub)], "crowd long, hub long")
    largest = sorted(held)[:10]
    roots = spark.createDataFrame([(k, min(largest)) for k in largest], "node long, root long")
    plain = jaccard.possible_across

    def checked(one, other, rule):
        low, high = (jaccard.unpack(x, *[np.int64] * 4, None)[2] for x in (one, other))
        both = np.concatenate((low, high))
        assert both.max() * 64 <= both.min() * 101
        return plain(one, other, rule)

    monkeypatch.setattr(jaccard, "possible_across", checked)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    found = set(as_rows(jaccard._across(crowds, hubs, roots, members, rule), "a", "b"))
    root = {k: min(largest) if k in largest else k for k in held}
    share = {(a, b): len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for a, x in held.items() for b, y in held.items() if a < b}
    linked = {p for p, v in share.items() if v >= 0.8 and root[p[0]] != root[p[1]]}
    assert len(linked) > 20 and linked <= found
    assert all(root[a] != root[b] for a, b in found)


def test_empty_segments_of_different_bands_are_no_match():
    rule, rng = jaccard.Rule(80, 100), np.random.default_rng(4)
    groups = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (20, 25, 32, 41, 52, 65, 82, 103) for _ in range(60)]
    value, owner, _ = (np.concatenate(x) for x in zip(*jaccard.signatures(groups, rule)))
    sizes = {}
    for v, o in zip(value.tolist(), owner.tolist()):
        sizes.setdefault(v, set()).add(len(groups[o]))
    assert any(len(s) > 1 for s in sizes.values())
    assert all(max(s) * 64 <= min(s) * 101 for s in sizes.values())


def test_only_probes_of_a_crowd_are_held_against_its_members(spark, monkeypatch):
    """Pairs without a probe are no match, whatever their maps say; all others that are linked are found."""
    rng, rule = np.random.default_rng(9), jaccard.Rule(80, 100)
    monkeypatch.setattr(jaccard, "PROBES", 3)
    monkeypatch.setattr(jaccard, "MEMBERS", 7)
    monkeypatch.setattr(jaccard, "MAPPED", 300)
    groups = []
    for n in (40, 90, 200, 400):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        groups += [np.unique(np.concatenate((base[gone:], base[:gone] + np.uint64(1)))) for gone in range(0, n // 8, max(1, n // 80))]
    held = {jaccard.digest(m): m for m in groups}
    flags = {k: (0, 1, 2, 3, 0, 2)[i % 6] for i, k in enumerate(held)}
    members = spark.createDataFrame(
        [(k, len(m), bytearray(jaccard.parity(m))) for k, m in held.items()], "node long, n_shingles long, bits binary"
    )
    crowds = spark.createDataFrame(
        [(c, k, len(held[k]), f) for c in (1, 2) for k, f in flags.items() if c == 1 or f != 1],
        "crowd long, node long, size int, flags int",
    )
    known = sorted(held)[:9]
    roots = spark.createDataFrame([(k, known[0]) for k in known], "node long, root long")
    found = as_rows(jaccard._probed(crowds, roots, members, rule), "a", "b")
    root = {k: known[0] if k in known else k for k in held}
    pairs = {(a, b) for a in held for b in held if a < b and root[a] != root[b]}
    match = {p for p in pairs if (flags[p[0]] | flags[p[1]]) & 1 and not flags[p[0]] & flags[p[1]] & 2}
    linked = {p for p in pairs if rule.linked(len(np.intersect1d(held[p[0]], held[p[1]])), len(held[p[0]]), len(held[p[1]]))}
    assert len(found) == len(set(found)) and len(linked & match) > 20 and linked - match
    assert linked & match <= set(found) <= match
