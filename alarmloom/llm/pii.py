"""Personal data by weak supervision, with DataFrame functions only.

Regular expressions propose candidate spans. Four labelers vote on each: its format
(checksums and ranges), a gazetteer (known domains, calling codes, given names, country
codes), cue words in front of it, and what it is attached to. Votes are counted by pattern,
expectation-maximisation estimates how reliable each labeler is and how likely each
pattern is personal data, and a logistic classifier is trained on those likelihoods and
the span's shape. Base spans stay whatever it says; the other kinds are kept if it
accepts them. Only counts by pattern reach the driver, whose number is bounded by kinds, votes
and shapes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# Kinds in their order, expressions, cues and gazetteers.
BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "ssn", "iban")
KINDS = BASE + ADDED
LOCAL = "A-Za-z0-9._%+-"
# A match starts where the last one ended or where a run of its signs begins, so no run is read twice.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][ -]))[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "name": (
        r"(?<![\p{L}])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Sr|Sra)\.? )?"
        r"(?:Alice|Anna|Carlos|Carmen|Charles|David|Elena|Emma|Hans|Isabel|James|Jean|John|Jose|Julia|Karl|Laura|Linda|"
        r"Lucia|Marie|Mary|Michael|Patricia|Paul|Peter|Pierre|Robert|Sophie|Susan|Thomas|William|Wolfgang)"
        r" [\p{Lu}][\p{L}'-]{1,30}(?![\p{L}])"
    ),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
# Signs that a text needs before an expression is tried.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
    "phone": r"\+[0-9]",
    "name": r"[\p{Lu}][\p{L}]+ [\p{Lu}]",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
VALID_IP = rf"^{PART}(?:\.{PART}){{3}}$"
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|correo|courriel|adresse)",
    "ip": r"(?i)(\bip\b|address|host|server|login|adresse)",
    "card": r"(?i)(card|visa|mastercard|payment|carte|karte|tarjeta|credit)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|telefon|numero|handy)",
    "name": r"(?i)(name|contact|dear|signed|author|mr\.?|mrs\.?|dr\.?|herr|frau|nombre|nom)\W*$",
    "ssn": r"(?i)(ssn|social|security|insurance)",
    "iban": r"(?i)(iban|account|bank|konto|compte|cuenta)",
}
AGAINST = r"(?i)(version|release|order|invoice|isbn|issn|section|chapter|build|serial|example)\W*$"
KNOWN = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ch|at|nl)$",
    "ip": r"^(?!0+\.|127\.|10\.|192\.168\.|255\.|2(?:2[4-9]|[34][0-9])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "name": r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Sr|Sra)",
    "ssn": r"^(?!000|666|9)",
    "iban": r"^(?:AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PT)",
}
LABELERS = ("format", "gazetteer", "cue", "border")
CUE_CHARS = 32
ROUNDS, STEPS, RATE = 60, 300, 0.5
SPAN = "struct<kind:string,rank:int,start:int,end:int,base:boolean,votes:array<int>,shape:int>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    back = F.reverse(digits)

    def weigh(total: Column, i: Column) -> Column:
        digit = F.substr(back, i, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh) % 10 == 0


def _iban(value: Column) -> Column:
    """Whether the remainder of the rearranged account number is 1."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        sign = F.substr(moved, i, F.lit(1))
        letter = F.ascii(sign) - 55
        return F.when(sign.rlike("[A-Z]"), (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(sign) - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    """The check of the format; for base kinds the one that base spans must pass."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(VALID_IP)
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ssn":
        return ~value.rlike("^000|-00-|-0000$")
    if kind == "iban":
        return _iban(value)
    return F.lit(True)


def _vote(condition: Column, other: int = -1) -> Column:
    return F.when(condition, 1).otherwise(other)


def _candidates(text: Column, kind: str) -> Column:
    """Spans of one kind with their votes, in code points, leftmost first and not overlapping.

    A text is split at the matches; places are running lengths of gaps and matches.
    """
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    nothing = F.array().cast(f"array<{SPAN}>")

    def add(held: Column, pair: Column) -> Column:
        value = pair["value"]
        start = held["at"] + F.length(pair["gap"])
        end = start + F.length(value)
        front = F.right(pair["gap"], F.lit(CUE_CHARS))
        valid = _valid(kind, value)
        cue = F.when(front.rlike(AGAINST), -1).when(front.rlike(CUES[kind]), 1).otherwise(0)
        border = _vote((F.length(front) == 0) | ~front.rlike(r"[\p{L}0-9_/=-]$"))
        votes = F.array(_vote(valid), _vote(value.rlike(KNOWN[kind]), 0), cue, border)
        shape = F.least(F.lit(3), F.floor(F.length(value) / 8)).cast("int")
        base = valid if kind in BASE else F.lit(False)
        span = F.struct(
            F.lit(kind).alias("kind"),
            F.lit(KINDS.index(kind)).alias("rank"),
            start.alias("start"),
            end.alias("end"),
            base.alias("base"),
            votes.alias("votes"),
            shape.alias("shape"),
        )
        return F.struct(end.alias("at"), F.concat(held["spans"], F.array(span)).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))
    found = F.aggregate(pairs, first, add, lambda held: held["spans"])
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(nothing)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans of each document, by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[_candidates(F.col("text"), kind) for kind in KINDS])
    # Sorted as start, rank, ..., as the order of fields is that of comparison.
    keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s.alias("span")))
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.transform(F.array_sort(keyed), lambda s: s["span"]).alias("spans")
    )


Pattern = tuple[str, tuple[int, ...], int]


def patterns(found: DataFrame) -> dict[Pattern, int]:
    """How many spans have each pattern of kind, votes and shape; counted before the shuffle."""
    one = found.select(F.explode("spans").alias("s"))
    rows = one.groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n")).collect()
    return {(r["kind"], tuple(r["votes"]), r["shape"]): r["n"] for r in sorted(rows, key=str)}


def reliabilities(counts: dict[Pattern, int]) -> tuple[dict[str, float], list[list[dict[int, float]]]]:
    """Share of personal data by kind, and each labeler's votes for personal data and for other spans.

    Expectation-maximisation over the counted patterns, with a prior of a few spans that
    makes labelers better than chance and keeps small tables stable.
    """
    share = {kind: 0.5 for kind in KINDS}
    start = [{1: 0.25, 0: 0.35, -1: 0.4}, {1: 0.55, 0: 0.35, -1: 0.1}]
    tables = [[dict(t) for t in start] for _ in LABELERS]
    for _ in range(ROUNDS):
        held = {kind: [2.0, 2.0] for kind in KINDS}
        votes = [[{v: 8 * p for v, p in t.items()} for t in start] for _ in LABELERS]
        for (kind, cast, _), n in counts.items():
            p = likelihood(share[kind], tables, cast)
            held[kind][1] += n * p
            held[kind][0] += n * (1 - p)
            for j, v in enumerate(cast):
                votes[j][1][v] += n * p
                votes[j][0][v] += n * (1 - p)
        share = {kind: h[1] / sum(h) for kind, h in held.items()}
        tables = [[{v: x / sum(t.values()) for v, x in t.items()} for t in pair] for pair in votes]
    return share, tables


def likelihood(share: float, tables: list[list[dict[int, float]]], votes: Iterable[int]) -> float:
    """Probability that a span with these votes is personal data."""
    yes, no = math.log(share), math.log(1 - share)
    for pair, v in zip(tables, votes):
        yes += math.log(pair[1][v])
        no += math.log(pair[0][v])
    return 1 / (1 + math.exp(min(700.0, no - yes)))


def _features(kind: str, votes: Iterable[int], shape: int) -> list[str]:
    return ["bias", f"kind {kind}", f"shape {shape}", *[f"{name} {v}" for name, v in zip(LABELERS, votes)]]


def classifier(counts: dict[Pattern, int]) -> dict[str, float]:
    """Weights of a logistic span classifier, trained on the likelihoods of all counted patterns."""
    share, tables = reliabilities(counts)
    total = sum(counts.values()) or 1
    rows = [(_features(*k), likelihood(share[k[0]], tables, k[1]), n / total) for k, n in counts.items()]
    weights: dict[str, float] = {}
    for _ in range(STEPS):
        slope: dict[str, float] = {name: -0.001 * w for name, w in weights.items()}
        for names, goal, n in rows:
            p = 1 / (1 + math.exp(-max(-700.0, sum(weights.get(x, 0.0) for x in names))))
            for x in names:
                slope[x] = slope.get(x, 0.0) + n * (goal - p)
        weights = {x: weights.get(x, 0.0) + RATE * s for x, s in slope.items()}
    return weights


def _accepted(span: Column, weights: dict[str, float]) -> Column:
    def of(prefix: str, value: Column, values: Iterable) -> Column:
        out = F.lit(0.0)
        for v in values:
            out = F.when(value == F.lit(v), F.lit(weights.get(f"{prefix} {v}", 0.0))).otherwise(out)
        return out

    score = F.lit(weights.get("bias", 0.0)) + of("kind", span["kind"], KINDS) + of("shape", span["shape"], range(4))
    for j, name in enumerate(LABELERS):
        score = score + of(name, span["votes"][j], (-1, 0, 1))
    return score > 0


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def find(docs: DataFrame) -> DataFrame:
    """Personal data of documents, one row per row of docs.

    Columns: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans
    (kind:start:end in code points, by start and kind, of base spans and of accepted ones
    of the other kinds). A missing or empty text has none. Other columns of docs are not
    looked at.
    """
    found = candidates(docs)
    weights = classifier(patterns(found))
    kept = F.filter("spans", lambda s: s["base"] | (s["kind"].isin(*ADDED) & _accepted(s, weights)))
    rows = found.select("doc_id", kept.alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    rows = rows.select("doc_id", "spans", base.alias("base"))
    counts = [F.size(F.filter("base", _is(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
