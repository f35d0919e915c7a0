"""Quality rules, exact dedup, SimHash, packing and byte-level BPE against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import byte_bpe, exact_dedup, packing, quality, simhash
from quillon.llm.queries import QUERIES


def brute_measures(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def check_quality(df):
    got = quality.quality(df).collect()
    texts = df.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:6])
    want = sorted(((r["doc_id"], *brute_measures(r["text"])) for r in texts), key=key)
    assert sorted((tuple(r)[:6] for r in got), key=key) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_measures(docs, edge):
    check_quality(docs)
    check_quality(edge)


def test_quality_of_nothing(empty):
    assert quality.quality(empty).count() == 0 and quality.keep_quality(empty).count() == 0


def test_quality_keeps_good_and_drops_bad(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_quality_stage_equals_query(docs, edge):
    kept = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_quality(docs).collect()} == kept
    assert quality.keep_quality(edge).columns == edge.columns


def test_em_recovers_accuracies():
    rng = random.Random(3)
    patterns = Counter()
    for _ in range(20_000):
        y = rng.random() < 0.7
        patterns[tuple(0 if rng.random() < 0.3 else (1 if y else -1) * (1 if rng.random() < p else -1) for p in (0.95, 0.9, 0.75))] += 1
    m = quality.fit_votes(sorted(patterns.items()), ("a", "b", "c"))
    assert abs(m.prior - 0.7) < 0.03 and all(abs(x - y) < 0.04 for x, y in zip(m.right_good, (0.95, 0.9, 0.75), strict=True))
    assert quality.fit_votes([], ("a",)).prior == 0.8


def test_exact_groups(docs, edge):
    for df in (docs, edge):
        rows = df.select("doc_id", "text").collect()
        norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        groups = {}
        for r in rows:
            groups.setdefault(norm(r), []).append(r)
        want = []
        for t, g in groups.items():
            keep = min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
            want += [(str(r["doc_id"]), str(keep), len(g), r["doc_id"] == keep, hashlib.sha256(t.encode()).hexdigest()) for r in g]
        assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in exact_dedup.exact_groups(df).collect()) == sorted(want)
        kept = exact_dedup.exact_distinct(df)
        assert kept.columns == df.columns and kept.count() == len(groups)
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({(x[1], x[4]): x[1] for x in want}.values())


def test_exact_of_nothing(empty):
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_distinct(empty).count() == 0


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                parent[find(a)] = find(b)
    return {f: find(f) for f in values}


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    root = components(set(fps))
    low = {}
    for r, f in zip(rows, fps, strict=True):
        if r["doc_id"] is not None:
            low[root[f]] = min(low.get(root[f], 1 << 62), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(low.get(root[f]))) for r, f in zip(rows, fps, strict=True))
    assert sorted(tuple(map(str, r)) for r in simhash.near_groups(df).collect()) == want


def test_links_are_whole(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values):
        for k in (1, 2, 3, 3, 4):
            x = v
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(-5, 200), (200, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys((-5, 200, 300), -5)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_nothing(empty, docs):
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.near_groups(docs).select("component_id").distinct().count()


def test_near_copies_go_by_row(spark):
    words = [f"w{i}" for i in range(300)]
    text, other, third = " ".join(words), " ".join(words[::-1]), " ".join(words[::2])
    rows = [(1, text), (None, text), (None, other), (None, third), (None, third), (5, "five"), (5, "another five"), (6, "five")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text), (None, other), (None, third), (5, "five"), (5, "another five")], key=str)


def brute_near_kept(rows, percent=80):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[i:] for i in range(5)), strict=False))

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or 100 * len(a & b) >= percent * len(a | b) > 0:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return [min((x for x, q in zip(rows, root, strict=True) if q == r), key=lambda x: (x[0] is None, x[0] or 0)) for r in sorted(set(root))]


def test_near_copies_of_five_words_are_whole(spark):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    line = [word() for _ in range(12)]
    rows = [(None, None), (None, "  "), (4, ""), (None, "a b"), (9, "A  b"), (9, "b a")]
    for n in (6, 30, 80, 200, 200, 201):  # families on both sides of the bound, one of them crowded
        base = [word() for _ in range(n)]
        for _ in range(60 if n == 201 else 8):
            text = list(base)
            for _ in range(rng.randrange(1 + n // 20)):
                text[rng.randrange(n)] = word()
            rows.append((rng.choice([None, len(rows) + 100, len(rows) + 100, 7]), " ".join(line[: rng.choice([0, 12])] + text)))
    rng.shuffle(rows)
    want = brute_near_kept(rows)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert len(got) == len(want) < len(rows) and len(simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()) != len(want)
    ids = lambda found: sorted(str(r[0]) for r in found)
    assert ids(got) == ids(want)


def check_packing(df, **options):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = packing.packed(df, path, **options).collect()
    pieces, load = {}, {}
    for r in rows:
        pieces.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
        load.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for d in df.select("doc_id", "text").distinct().collect():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted(pieces[str(d["doc_id"]), len(ids)], key=lambda r: r["start"])
        copies = sum(r["length"] for r in own) // len(ids)
        total += copies * len(ids)
        covered = Counter()
        for r in own:
            covered[r["start"], r["length"]] += 1
            assert ids[r["start"] : r["start"] + r["length"]].tobytes() == bytes(r["ids"])
        seen = np.zeros(len(ids), int)
        for (s, n), c in covered.items():
            seen[s : s + n] += c
        assert (seen == copies).all()
    assert total == sum(r["length"] for r in rows)
    for parts in load.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return total, len(load)


def test_packing(docs, edge, empty):
    total, windows = check_packing(docs)
    assert total / windows / 2048 > 0.97
    check_packing(edge)
    check_packing(docs.limit(60), group_tokens=5000, piece=64)
    assert packing.packed(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([64, 512, 2048]))
@settings(max_examples=60, deadline=None)
def test_pack_properties(lengths, piece):
    rows = packing.pack(lengths, 2048, piece)
    seen, load = [np.zeros(n, int) for n in lengths], Counter()
    for d, s, n, w, o in rows:
        seen[d][s : s + n] += 1
        assert o + n <= 2048
        load[w] += n
    assert all((x == 1).all() for x in seen) and max(load.values(), default=0) <= 2048
    assert sorted(load) == list(range(len(load)))


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 500) for _ in range(900)]
    sets = packing.differencing(sizes, 100)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(900)) and max(sums) - min(sums) < 40
    assert packing.differencing([], 3) == [[], [], []]


@given(st.lists(st.integers(1, 40), max_size=25), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_differencing_by_its_definition(sizes, ways):
    """Partial partitions with all their sums, merged largest imbalance first."""
    parts = [(n, [(s, (i,))] + [(0, ())] * (ways - 1)) for n, (i, s) in enumerate(sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])))]
    number = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][-1][0] - p[1][0][0], p[0]))
        a, b, *parts = parts
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a[1], reversed(b[1]), strict=True)), key=lambda x: -x[0])
        parts.append((number, merged))
        number += 1
    want = sorted(s for s, _ in parts[0][1]) if parts else [0] * ways
    assert sorted(sum(sizes[i] for i in s) for s in packing.differencing(sizes, ways)) == want


def test_added_tokens_in_a_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.byte_bpe_encoder(path)
    for text in ("x <|endoftext|> y", "<|endoftext|><|endoftext|>", "plain", "<|endoftext", "a<|endoftext|>" * 300):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert 50256 in encode("x <|endoftext|> y")


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(coder):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@given(st.lists(st.text(alphabet=st.sampled_from("abAB \n\t'sédü漢😀0019!?_²"), max_size=200), max_size=8))
@settings(max_examples=80, deadline=None)
def test_bpe_equals_tiktoken(coder, tik, texts):
    for text, ids in zip(texts, coder.encode_texts(texts), strict=True):
        numbers = np.frombuffer(ids, "<u4").tolist()
        assert numbers == tik.encode_ordinary(text) and coder.decode(numbers) == text.encode()


def test_bpe_of_long_pre_tokens(coder, tik):
    for text in ("a" * 30_000, "ab" * 15_000, "漢" * 5000, " " * 20_000):
        assert np.frombuffer(next(coder.encode_texts([text])), "<u4").tolist() == tik.encode_ordinary(text)


def test_bpe_query(docs, edge, empty, tik):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for df in (docs, edge):
        texts = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array(tik.encode_ordinary(r["text"] or ""), dtype="<u4")
            texts[str(r["doc_id"]), ids.tobytes(), (r["text"] or "").encode()] += 1
        got = byte_bpe.coded(df, path, public_tokenizers.PATTERN).collect()
        assert Counter((str(r[0]), bytes(r[1]), bytes(r[2])) for r in got) == texts
    assert byte_bpe.coded(empty, path, public_tokenizers.PATTERN).count() == 0


def test_digest_columns(spark, sf_dir, docs, tik):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in QUERIES["op9_byte_bpe"](spark, sf_dir).collect():
        ids = np.array(tik.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    pieces = QUERIES["op1_packing"](spark, sf_dir).join(packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "ids"), ["doc_id", "start"])
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in pieces.collect())


def test_rank_queue():
    q, rng = byte_bpe.RankQueue(50_257), random.Random(2)
    ranks = [rng.randrange(50_257) for _ in range(500)]
    for i, r in enumerate(ranks):
        q.push(r, i)
    out = []
    while (r := q.lowest()) >= 0:
        out += [r] * len(q.take(r))
    assert out == sorted(ranks)
