"""Texts that meet by chance, as more do in a larger table, leave the values where they meet."""

import random

import numpy as np
import pytest

from quillon.llm import near_copies


def test_rows_grow_with_the_texts_not_with_chance_meetings(spark, monkeypatch):
    """Values of 24 bits in all, so that few texts meet as many by chance as those of a large table do."""
    balls, cut, moved = near_copies.balls, near_copies.cut, []
    entries = near_copies._entries
    monkeypatch.setattr(near_copies, "balls", lambda values, unsure: (balls(values, unsure) * 0x9E3779B97F4A7 >> 24) % (1 << 24))

    def counted(df):
        out = cut(df)
        moved.append((out.columns, out.count()))
        return out

    def made(nodes, *names):
        moved.append((["entries", *names], 352 * nodes.count()))
        return entries(nodes, *names)

    monkeypatch.setattr(near_copies, "cut", counted)
    monkeypatch.setattr(near_copies, "_entries", made)
    rows = []
    for families in (10, 50):
        rng, texts, want = random.Random(families), [], set()
        for f in range(families):
            origin = [f"w{rng.randrange(10**6)}" for _ in range(100)]
            want |= {len(texts), *range(len(texts) + 2, len(texts) + 5)}
            texts += [" ".join(origin), " ".join([*origin[:f], "x", *origin[f + 1 :]])] + [" ".join(f"y{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3)]
        moved.clear()
        got = {r["doc_id"] for r in near_copies.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
        assert got == want
        posts = [n for columns, n in moved if columns[:2] == ["node", "token"]]
        blocks = [n for columns, n in moved if columns[0] == "entries" and columns[1:] != ["node"]]
        rows.append(max([*posts, *blocks]))
    assert 0 < rows[1] <= 6 * rows[0], rows  # five times the texts


def brute(token, words):
    near = []
    for i in range(len(token)):
        near.append(any(j != i and token[j] == token[i] and sum(int(a ^ b).bit_count() for a, b in zip(words[i].tolist(), words[j].tolist(), strict=True)) <= near_copies.DISTANCE for j in range(len(token))))
    return near


def fingerprinted(rng, sizes):
    """Tokens and words of values of so many texts: some near one another, some not, in any order."""
    token, words = [], []
    for t, n in enumerate(sizes):
        origins = rng.integers(0, 1 << 64, (3, 8), np.uint64)
        for _ in range(n):
            kind = rng.integers(0, 4)
            w = rng.integers(0, 1 << 64, 8, np.uint64) if kind == 3 else origins[kind].copy()
            for b in rng.integers(0, 512, rng.choice([10, 50, 70])):
                w[b // 64] ^= np.uint64(1 << int(b % 64))
            token.append(t * 5)
            words.append(w)
    return np.array(token, np.int64), np.array(words).reshape(-1, 8)


@pytest.mark.parametrize("neighbours", [1, 8])
def test_near_another_equals_brute_force(monkeypatch, neighbours):
    monkeypatch.setattr(near_copies, "NEIGHBOURS", neighbours)
    token, words = fingerprinted(np.random.default_rng(neighbours), [1, 2, 2, 2, 3, 40, 1, 17, 9])
    want = brute(token, words)
    assert near_copies._near_another(token, words).tolist() == want and 20 < sum(want) < len(want)
    assert near_copies._near_another(token[:0], words[:0]).tolist() == []
    monkeypatch.setattr(near_copies, "VALUE_PAIRS", 30)  # values with more to compare stay whole
    got = near_copies._near_another(token, words)
    assert all(g for g, w in zip(got, want, strict=True) if w)


@pytest.mark.parametrize("value_texts", [1 << 16, 20])
def test_values_over_several_batches(spark, monkeypatch, value_texts):
    monkeypatch.setattr(near_copies, "VALUE_TEXTS", value_texts)
    token, words = fingerprinted(np.random.default_rng(3), [1, 2, 60, 2, 3, 8, 1, 5, 0, 2])
    want = brute(token, words)
    rows = [(int(1000 - i), int(t), bytearray(w.astype("<u8").tobytes())) for i, (t, w) in enumerate(zip(token, words, strict=True))]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        df = spark.createDataFrame(rows, "node long, token long, fp binary")
        got = near_copies._met(df.repartition(3)).collect()
        place = {r["node"]: r["place"] for r in df.selectExpr("node", "xxhash64(node) as place").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    kept = {(r["node"], r["token"]) for r in got}
    need = {(n, t) for (n, t, _), w in zip(rows, want, strict=True) if w}
    large = {(n, t) for n, t, _ in rows if t == 10 and value_texts == 20}
    assert len(kept) == len(got) and need <= kept <= need | large
    for t in {t for _, t in kept}:
        centres = {r["centre"] for r in got if r["token"] == t}
        assert centres == {min((n for n, x in kept if x == t), key=place.get)}
