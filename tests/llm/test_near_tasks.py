"""Tasks of near copies on few texts where a session has many shuffle partitions, and components by tasks and by rounds."""

import random
import time

import pytest

from quillon.llm import near_copies, simhash

PARTITIONS = 40


def test_few_texts_cost_few_tasks_whatever_the_partitions(spark):
    rng = random.Random(5)
    origin = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts = [" ".join([*origin[:at], f"x{at}", *origin[at + 1 :]]) for at in range(0, 100, 10)] + [" ".join(f"y{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were, tracker = {k: spark.conf.get(k) for k in held}, spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        before = set(tracker.getJobIdsForGroup(None))
        got = near_copies.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).count()
        time.sleep(2)  # for the listeners
        jobs = [tracker.getJobInfo(j) for j in set(tracker.getJobIdsForGroup(None)) - before]
        stages = {s for j in jobs if j for s in j.stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert got == 21
    assert 0 < tasks < 50 * PARTITIONS, tasks


@pytest.mark.parametrize("edges_a_task", [7, 1 << 15])
def test_components_by_tasks_and_by_rounds_equal_plain_ones(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(simhash, "EDGES", edges_a_task)
    rng = random.Random(edges_a_task)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(50)] + [(900, x) for x in range(901, 930)] + [(x, x + 1) for x in range(-500, -470)] + [(7000, 7000)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rows = simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(got) and got == {x: find(x) for x in root if x != 7000}


def test_a_large_block_goes_once_to_each_bin_of_small_ones(spark):
    small, large = 300, [1000, 1001]
    sizes = [(b, 10, 1) for b in range(small)] + [(b, 5000, 500) for b in large]
    met = [(b, x) for b in range(small) for x in large] + [tuple(large)] + [(b, b) for b in (1, 1000)]
    dealt = near_copies._dealt(spark.createDataFrame(met, "one long, two long"), spark.createDataFrame(sizes, "block long, hashes long, texts long"))
    groups = {}
    for r in dealt.collect():
        groups.setdefault((r["owner"], r["bin"]), {}).setdefault(r["side"], set()).add(r["block"])
    pairs = sorted(tuple(sorted((a, b))) for g in groups.values() if 1 in g for a in g[0] for b in g[1])
    assert pairs == sorted(x for x in met if x[0] != x[1])  # each once
    assert {o for (o, bin_), g in groups.items() if bin_ == -1 and g == {0: {o}}} == set(large)
    texts = {b: n for b, _, n in sizes}
    assert sum(texts[b] for g in groups.values() for side in g.values() for b in side) < 5000  # 301 600 as pairs of blocks
