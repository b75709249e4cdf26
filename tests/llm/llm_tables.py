"""Small tables with awkward rows, and words as the contracts take them."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = "id long, key string, ref string, n_words string, spans string, ranges string, bucket string, train string, kept int"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate(LOWER)


def awkward(spark, extra=(), clashing=False):
    """Documents with nulls, empty and long texts, ties and repeated rows, in several partitions."""
    rng = random.Random(7)
    base = " ".join(rng.choice("the of and le la der die that with grün 日本 Thé x1 y2".split()) for _ in range(90))
    near = base.replace("with", "without", 1)
    texts = ["", None, " \t\n", "one", "one two", base, base, near, base.upper(), base + "\n" + base, "a" * 3000, "ab " * 900]
    texts += ["zero\x00width ퟿ \U0001f389 done", *extra]
    rows = [(i, t, rng.choice(["en", "fr", None]), "src0", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (6, near, "en", None, None), (None, base, "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        for column in CLASHING.split(", "):
            name, kind = column.split()
            docs = docs.withColumn(name, F.lit(1).cast(kind))
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def as_rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
