"""Components of links against a plain search, and the tasks that few links take."""

import random

import pytest

from alarmloom.llm import components


def brute(links):
    root = {}
    for pair in links:
        for node in pair:
            root.setdefault(node, node)

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return sorted((node, find(node)) for node in root if len(links))


def drawn(seed):
    rng = random.Random(seed)
    chain = [(k, k + 1) for k in range(1000, 1040)]
    star = [(-5, k) for k in range(2000, 2030)]
    return chain + star + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7), (7, 8), (8, 7)]


@pytest.mark.parametrize("few", [1 << 18, 60, 0])
def test_components_in_all_layouts(spark, monkeypatch, few):
    monkeypatch.setattr(components, "ROUND_ROWS", few)
    links = drawn(3)
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    found = sorted(map(tuple, components.components(table).collect()))
    assert found == brute([x for x in links if x[0] != x[1]])
    assert components.components(table.limit(0)).collect() == []


def test_rounds_of_few_links_are_few_tasks(spark):
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(drawn(4), "a long, b long").repartition(5)
        context.setJobGroup("few links", "")
        assert components.components(table).count() > 0
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("few links") for s in status.getJobInfo(job).stageIds}
    # The first step and its count have a task for each partition, and so has the last; the rounds do not.
    assert sum(status.getStageInfo(s).numTasks for s in stages if status.getStageInfo(s)) < 64 * 10
