"""The whole pipeline against its stages done by hand on a small table."""

import corpus_pipeline as pipeline
import pytest
from llm_tables import empty, texts_of

from alarmloom.llm import decontaminate, pieces, quality, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def test_names_and_columns(stages):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality_rules",
        "ngram_jaccard_join",
        "benchmark_decontamination",
        "secret_scans",
        "sentencepiece_encoding",
    ]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_rejected_documents_go(stages):
    kept = {r["doc_id"] for r in quality.judge(stages[0]).where("kept").collect()}
    assert {d for d, _ in texts_of(stages[1])} == kept


def test_one_document_of_each_group_stays(stages):
    rows = texts_of(stages[1])
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in rows if (w := t.lower().split())}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for d in sorted(sets):
        for other in {o for s in sets[d] for o in by_shingle.get(s, ())}:
            if 100 * len(sets[d] & sets[other]) >= 80 * len(sets[d] | sets[other]):
                a, b = sorted((find(d), find(other)))
                parent[b] = a
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    assert {d for d, _ in texts_of(stages[2])} == {find(d) for d in sets}


def test_benchmark_and_secrets_are_gone(spark, stages):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find(stages[3], benchmark).where("contaminated").count() == 0
    assert len(texts_of(stages[3])) == len(texts_of(stages[2]))
    found = secrets.automaton()
    assert not any(secrets.find(t or "", found) for _, t in texts_of(stages[4]))
    clean = {d: t for d, t in texts_of(stages[3]) if not secrets.find(t, found)}
    assert clean.items() <= dict(texts_of(stages[4])).items()


def test_run_encodes_what_is_left(spark, stages):
    ran = pipeline.run(spark, SF)
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode(ran).collect()}
    assert decoded == dict(texts_of(stages[4]))


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_operators_swallow_no_import_errors():
    text = open(pipeline.__file__).read()
    assert "ImportError" not in text and "except" not in text
