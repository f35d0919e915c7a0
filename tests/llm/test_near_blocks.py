"""Near copies compared by blocks of texts: counts against plain sets, and a family on both sides of the bound."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import near_copies


@pytest.mark.parametrize("many", [False, True])
def test_common_hashes_equal_plain_sets(many):
    rng = random.Random(many)
    sets = {rng.randrange(1 << 60): sorted({rng.randrange(-40, 40) for _ in range(rng.choice([0, 1, 30]))}) for _ in range(24)}
    nodes = list(sets)
    pairs = [(a, b) for a in nodes for b in nodes if a < b]
    pairs = pairs if many else rng.sample(pairs, 20)
    rng.shuffle(nodes)
    a, b = map(np.array, zip(*pairs, strict=True))
    size = lambda ends: pa.array([len(sets[int(x)]) for x in ends], pa.int64())
    got = near_copies._common(pa.table({"a": a, "b": b, "a_size": size(a), "b_size": size(b)}), pa.table({"node": pa.array(nodes, pa.int64()), "tokens": pa.array([sets[n] for n in nodes], pa.list_(pa.int64()))}))
    assert got.column("common").to_pylist() == [len(set(sets[x]) & set(sets[y])) for x, y in pairs]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_a_family_on_both_sides_of_the_bound(spark, monkeypatch):
    """260 texts of one origin, most pairs of which lie between 0.5 and 0.9; small blocks, so that many pairs of blocks are compared."""
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", 20)
    rng = random.Random(4)
    origin = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(260):
        words = list(origin)
        for _ in range(rng.choice([1, 3, 5, 6])):
            words[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(100)) for _ in range(40)]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 180 * common >= 80 * (len(sets[i]) + len(sets[j])):
                close += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {find(i) for i in range(len(texts))}
    got = {r["doc_id"] for r in near_copies.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert close > 1000 and 40 < len(want) < 250 and got == want


def test_rows_that_repeat_id_and_text_leave_the_same_one_each_time(spark):
    rows = [(1, "a b c d e f", x) for x in ("z", "m", "q")] + [(None, "", "u"), (None, "", None)]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string, other string").repartition(3)).collect()
        assert sorted((str(r["doc_id"]), r["other"]) for r in got if r["doc_id"]) == [("1", "m")] and len(got) == 2
