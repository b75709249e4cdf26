"""Filter interactions against a loop over all orders."""

from itertools import permutations

from llm_tables import as_rows, awkward, empty, words

from alarmloom.llm import audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id long, quality int, toxic int"
LABELLED = [(0, 1, 0), (1, 1, None), (3, 0, 1), (5, 1, 1), (5, 0, 0), (6, None, 1), (7, 1, 0), (None, 1, 1), (9999, 1, 1)]


def failed(text):
    w = words(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    marks = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * capitals > 5 * len(text), any(c in "#$%&*|" for c in text)]
    return {x for x, hit in zip("ABCD", marks) if hit}


def brute(rows, labels):
    key = lambda d: (d is None, d or 0)
    least = {}
    for d, text, _ in rows:
        least[text or ""] = min(least.get(text or "", (True, 1)), key(d))
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    parts = {}
    for d, text, source in rows:
        f = failed(text or "") | ({"E"} if key(d) > least[text or ""] else set())
        parts.setdefault(source or "", []).append((f, d in good, d in toxic))
    out = []
    for part, docs in parts.items():
        table, total = [], {}
        for order in permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order, 1):
                fails = {i for i, (f, _, _) in enumerate(docs) if letter in f}
                now = fails - gone
                total[letter] = total.get(letter, 0) + len(now)
                lost = [sum(docs[i][k] for i in now) for k in (1, 2)]
                alone = sum(f == {letter} for f, _, _ in docs)
                table.append(("".join(order), step, len(docs) - len(gone | now), len(now), len(fails & gone), alone, *lost, letter))
                gone |= now
        out += [(part, *row[:-1], total[row[-1]]) for row in table]
    return sorted(out, key=repr)


EXTRA = ["WORD " * 60, "a|b " * 70, " ".join(f"w{i}" for i in range(80)), " ".join(f"W{i} $" for i in range(80)), "x" * 90_000 + " y"]


def test_all_orders_on_awkward_rows(spark):
    docs = awkward(spark, extra=[*EXTRA, *EXTRA])
    labels = spark.createDataFrame(LABELLED, LABELS).repartition(2)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    expected = brute(rows, LABELLED)
    assert as_rows(audit.audit(docs, labels), *COLUMNS) == expected
    clashing = awkward(spark, extra=[*EXTRA, *EXTRA], clashing=True)
    wide = labels.selectExpr("*", "'x' AS part", "1 AS mask", "2 AS digest", "3 AS n", "4 AS id")
    assert as_rows(audit.audit(clashing, wide), *COLUMNS) == expected


def test_empty_tables(spark):
    labels = spark.createDataFrame(LABELLED, LABELS)
    assert audit.audit(empty(spark), labels).collect() == []
    found = audit.audit(awkward(spark), labels.limit(0)).collect()
    assert {(r["good_lost"], r["toxic_lost"]) for r in found} == {(0, 0)}


def test_intervals_cover_each_order_once_per_mask():
    for n in (1, 3, 5):
        ranks = {p: i for i, p in enumerate(permutations(range(n)))}
        held = {}
        for mask, step, low, high in audit.intervals(n):
            for rank in range(low, high):
                assert held.setdefault((mask, rank), step) == step
        for mask in range(1, 1 << n):
            for order, rank in ranks.items():
                assert held[mask, rank] == 1 + next(k for k, x in enumerate(order) if mask >> x & 1)


def test_fewer_filters(spark):
    found = spark.createDataFrame([("p", 3, 4, 1, 0), ("p", 0, 2, 2, 0), ("p", 2, 5, 0, 5)], "part string, mask int, n long, good long, toxic long")
    rows = as_rows(audit.interactions(found, "XY"), *COLUMNS)
    assert rows == [
        ("p", "XY", 1, 7, 4, 0, 0, 1, 0, 4),
        ("p", "XY", 2, 2, 5, 4, 5, 0, 5, 14),
        ("p", "YX", 1, 2, 9, 0, 5, 1, 5, 14),
        ("p", "YX", 2, 2, 0, 4, 0, 0, 0, 4),
    ]
