"""Personal data and secrets against plain searches with the contracts' expressions."""

import hashlib
import random
import re

import pytest
from llm_tables import as_rows, awkward, empty, texts_of

from alarmloom.llm import pii, secrets

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def luhn(digits):
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
        "assign": lambda: len(m[2]) >= 6,
        "access": lambda: len(m[0]) >= 20,
        "hex": lambda: len(m[0]) >= 24,
    }[kind]()


def brute(rows, rules):
    out = []
    for doc_id, text in rows:
        spans = [
            (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
            for rank, (kind, rule) in enumerate(rules.items())
            for m in re.finditer(rule, text or "")
            if passes(kind, m)
        ]
        shown = [s for _, _, s in sorted(spans)]
        counts = [sum(s.startswith(kind + ":") for s in shown) for kind in rules]
        out.append((doc_id, *counts, hashlib.sha256(",".join(shown).encode()).hexdigest()))
    return sorted(out, key=repr)


def mixed(signs, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


PII_SIGNS = ["a@", "b.c", "@", ".", "1", "23", "4111", "-", " ", "+", "(", "256.", "1.", "é", "\n", "\U0001f389", "0", "11"]
SECRET_SIGNS = ["token", "API_KEY", "apikey", "secret", "=", ":", '"', " ", "abc123", "0a1b2c3d4e5f6071", "AKIA", "ABCDEFGH12", "é", "ſ", "\n"]


def test_base_personal_data(spark):
    hard = ["4111 1111 1111 1111", "a" * 30000 + "@x.y", "1.2." * 2000, "a@b.c_x@y.z", "+1 (499) 555-6503 01.002.3.255", "a@b" + ".c" * 9000]
    docs = awkward(spark, extra=hard + mixed(PII_SIGNS, 300, 5), clashing=True)
    found = pii.find(docs)
    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert as_rows(found, *names) == brute(texts_of(docs), PII)
    for row in found.collect():
        base = [s for s in row["spans"].split(",") if s.split(":")[0] in PII]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == row["base_sha256"]


def test_added_personal_data(spark):
    told = "Contact: Mr. John Smith, SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00."
    plain = "Serial 000-00-0000 and John came with Paul"
    docs = spark.createDataFrame([(1, told), (2, plain)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    kinds = [s.split(":")[0] for s in spans[1].split(",")]
    assert kinds == ["name", "ssn", "iban"]
    assert "ssn" not in spans[2]


def test_labelers_that_agree_are_found_reliable():
    counts = {("ssn", (1, 1, 1, 1), 1): 90, ("ssn", (-1, -1, 0, -1), 1): 100, ("ssn", (1, -1, 0, -1), 1): 10}
    share, tables = pii.reliabilities(counts)
    assert 0.35 < share["ssn"] < 0.6
    assert tables[1][1][1] > 0.9 and tables[1][0][-1] > 0.9
    weights = pii.classifier(counts)
    value = lambda votes: sum(weights[x] for x in pii._features("ssn", votes, 1))
    assert value((1, 1, 1, 1)) > 0 > value((-1, -1, 0, -1))


def test_base_secrets(spark):
    docs = awkward(spark, extra=mixed(SECRET_SIGNS, 300, 6) + ["f" * 5000, "x" * 23 + "a" * 24, "token" * 2000], clashing=True)
    found = secrets.scan(docs)
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert as_rows(found, *names) == brute(texts_of(docs), SECRETS)


def test_checksums_decide_on_tokens():
    words = secrets.automaton()
    payload = "Ab3" * 10
    good = f"ghp_{payload}{secrets.base62_crc(payload)}"
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    kinds = lambda t: [k for _, _, k in secrets.find(t, words) if k in secrets.ADDED]
    assert kinds(f"x {good} y") == ["github"]
    assert kinds(f"x {bad} y") == []
    assert kinds("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc-_1") == ["jwt"]
    assert kinds("eyJub3QganNvbg.eyJzdWIiOiIxIn0.abc-_1") == []
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----") == ["pem"]


def test_redacted_texts_hold_no_base_secret(spark):
    docs = awkward(spark, extra=mixed(SECRET_SIGNS, 100, 8), clashing=True)
    done = secrets.redacted(docs, "")
    assert done.columns == docs.columns
    before = dict((r[0], r) for r in brute(texts_of(docs), SECRETS))
    for doc_id, text in texts_of(done):
        if doc_id is not None and not sum(before[doc_id][1:4]):
            assert (doc_id, text) in texts_of(docs)


@pytest.mark.parametrize("find", [pii.find, secrets.scan, secrets.redacted])
def test_empty_tables(spark, find):
    assert find(empty(spark)).collect() == []
