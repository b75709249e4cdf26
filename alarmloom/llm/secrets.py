"""Secret scan: a keyword automaton, anchored expressions near its hits, then checksums.

One pass over the documents, without a shuffle. An Aho-Corasick automaton reads the
lower-cased text once; every rule's expression is tried only where one of its keywords
was seen. Runs of hexadecimal digits have no keyword, so they are found as 24 equal
signs in the text whose hexadecimal digits are folded into one sign. Tokens that carry a
checksum are kept only if it is right.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alarmloom.llm.shared import batch, blocks, keyed

# The base kinds in their order, then the kinds the method adds.
BASE = ("assign", "access", "hex")
ADDED = ("github", "npm", "jwt", "pem")
ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "api_key": "assign",
    "apikey": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
PEM_END = "-----END"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {i: i + 32 for i in range(65, 91)}
FOLD = bytes(35 if chr(i) in "0123456789abcdef" else 32 for i in range(256))

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
    ]
)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def base62_crc(payload: str) -> str:
    """The checksum of an access token: CRC-32 of the payload in base 62, six signs."""
    left, out = zlib.crc32(payload.encode()), ""
    while left:
        left, digit = divmod(left, 62)
        out = DIGITS[digit] + out
    return out.rjust(6, "0")


def _is_jwt(head: str) -> bool:
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(value, dict) and "alg" in value


def _base(text: str, starts: dict[str, list[int]]) -> Iterator[tuple[int, int, str]]:
    at = 0
    for start in starts.get("assign", ()):
        if start >= at and (m := ASSIGN.match(text, start)):
            at = m.end()
            if m.end(2) - m.start(2) >= ASSIGN_MIN:
                yield start, at, "assign"
    at = 0
    for start in starts.get("access", ()):
        if start >= at and (m := ACCESS.match(text, start)):
            at = m.end()
            if at - start >= ACCESS_MIN:
                yield start, at, "access"


def _hex(text: str) -> Iterator[tuple[int, int, str]]:
    # A sign outside Latin-1 counts as one other sign, so places stay code points.
    folded = text.encode("latin-1", "replace").translate(FOLD)
    least = b"#" * HEX_MIN
    at = folded.find(least)
    while at >= 0:
        end = folded.find(b" ", at)
        end = len(folded) if end < 0 else end
        yield at, end, "hex"
        at = folded.find(least, end)


def _added(text: str, starts: dict[str, list[int]]) -> Iterator[tuple[int, int, str]]:
    for kind, rule in (("github", GITHUB), ("npm", NPM)):
        for start in starts.get(kind, ()):
            if (m := rule.match(text, start)) and base62_crc(m[1]) == m[2]:
                yield start, m.end(), kind
    at = 0
    for start in starts.get("jwt", ()):
        if start >= at and (m := JWT.match(text, start)):
            at = m.end()
            if _is_jwt(m[1]):
                yield start, m.end(), "jwt"
    at = 0
    for start in starts.get("pem", ()):
        if start >= at and (m := PEM.match(text, start)):
            end = text.find(PEM_END, m.end())
            stop = text.find("-----", end + len(PEM_END)) if end >= 0 else -1
            at = stop + 5 if stop >= 0 else m.end()
            yield start, at, "pem"


def find(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind."""
    starts: dict[str, list[int]] = {}
    for last, (kind, n) in words.iter(text.translate(LOWER)):
        starts.setdefault(kind, []).append(last - n + 1)
    for found in starts.values():
        found.sort()
    spans = [*_base(text, starts), *_hex(text), *_added(text, starts)]
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with every maximal run of spans replaced by the mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """Counts and places of secrets, one row per row of docs.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in
    code points, by start and kind). A missing or empty text has none. Repeated rows each
    give a row; other columns of docs are not looked at.
    """

    def work(batches):
        words = automaton()
        for part in blocks(batches):
            columns: list[list] = [[] for _ in SCHEMA]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                spans = find(text.decode("utf-8", "replace"), words)
                shown = [(kind, f"{kind}:{start}:{end}") for start, end, kind in spans]
                base = [s for kind, s in shown if kind in BASE]
                counts = [sum(kind == k for kind, _ in shown) for k in BASE]
                digest = hashlib.sha256(",".join(base).encode()).hexdigest()
                for column, value in zip(columns, [doc_id, *counts, digest, ",".join(s for _, s in shown)]):
                    column.append(value)
            yield batch(SCHEMA, columns)

    return keyed(docs).select("doc_id", "text").mapInArrow(
        work, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret in `text` replaced by the mark; n_chars follows if there is one.

    All columns stay, missing texts stay missing, and texts without a secret stay as they are.
    """
    schema = docs.schema

    def work(batches):
        words = automaton()
        for part in batches:
            texts = []
            for text in part.column("text").to_pylist():
                spans = find(text, words) if text else []
                texts.append(redact(text, spans, mark) if spans else text)
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return with_length(docs.mapInArrow(work, schema))


def with_length(docs: DataFrame) -> DataFrame:
    """Sets n_chars to the length of the text, in tables that have the column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))
