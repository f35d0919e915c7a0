"""WARC archives, vector codes and periodic runs against brute force and exact round trips, with edge cases."""

import base64
import gzip
import hashlib
import io
import random
import re
from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import periods, vector_codes, warc
from quillon.llm.common import shared_folder

# ---- archives

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>same</p>"), (3, None, "<p>same</p>"), (None, "http://a/n", "<p>same</p>"), (None, "u", "alone"),
    (4, "http://a/4\r\nX-Evil: 1", ""), (5, "http://a/5", None), (6, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), (7, "漢字", "Été 漢字😀" * 5000), (8, "u", "x"), (9, "u", "y" * 70_001),
]


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def through(pages, chunk=warc.CHUNK, **options):
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    archives = warc.write(pages, folder, chunk=chunk, **options)
    return archives, folder, warc.read(archives, folder, chunk=chunk)


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name in ("id", "__id", "__p", "sha1", "keep", "archive", "record", "__sha1", "__at", "last"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.mark.parametrize("chunk", [7, 4096, warc.CHUNK])
def test_round_trip_of_every_payload(pages, chunk):
    archives, _, table = through(pages.repartition(3), chunk)
    by_record = {}
    for r in sorted(table.collect(), key=lambda r: (r["archive"], r["record"], r["chunk"])):
        assert len(r["content"]) <= chunk
        by_record.setdefault((r["archive"], r["record"]), []).append(r)
    for rows in by_record.values():
        payload = b""
        for n, r in enumerate(rows):
            payload += r["content"]
            assert r["chunk"] == n and r["bytes_so_far"] == len(payload) and r["digest_so_far"] == b32(payload) and r["last"] == (n == len(rows) - 1)
        if rows[0]["record_type"] == "response":
            assert rows[0]["declared_bytes"] == len(payload) and rows[0]["declared_digest"] == b32(payload)
    responses = sorted((str(rs[0]["page_id"]), b"".join(r["content"] for r in rs)) for rs in by_record.values() if rs[0]["record_type"] == "response")
    payload = {i: (h or "").encode() for i, _, h in PAGES}
    assert responses == sorted([(str(i), payload[i]) for i in (3, 3, 5, 6, 7, 8, 9)] + [("None", b"alone")])
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES) + archives.count()


def test_records_of_edge_cases(pages):
    got = sorted((str(r["page_id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.records(through(pages)[2]).collect())
    url = lambda u: u and u.replace("\r", "%0D").replace("\n", "%0A")
    want, largest = [], {"<p>same</p>": 3, "": 5}
    for i, u, h in PAGES:
        p, keep = (h or "").encode(), largest.get(h or "", i)
        want.append((str(i), url(u), len(p), b32(p), "response" if i == keep else "revisit", None if i == keep else keep))
    assert got == sorted(want, key=lambda r: tuple(map(str, r))) or sorted(map(str, got)) == sorted(map(str, want))


def test_small_payloads_are_not_revisited(pages):
    rows = warc.records(through(pages, least=1)[2]).collect()
    assert {(r["page_id"], r["record_type"]) for r in rows if r["payload_bytes"] == 0} == {(4, "response"), (5, "response")}
    assert sum(r["record_type"] == "revisit" for r in rows) == 3


def test_archives_roll_and_others_can_read_them(pages):
    archives, folder, table = through(pages.coalesce(1), roll=2000)
    assert archives.count() > 1 and table.filter("last").count() == len(PAGES)
    store, base = warc._store(folder)
    for r in archives.collect():
        with store.open_input_stream(f"{base}/{r['archive']}", compression=None) as f:
            plain = gzip.decompress(f.read())
        # An archive that is not packed gives the same rows, read in small pieces too.
        rows = list(warc.chunks(io.BytesIO(plain), 1000))
        assert rows == list(warc.chunks(io.BytesIO(gzip.compress(plain[:100]) + gzip.compress(plain[100:])), 1000))
        assert len({x[0] for x in rows}) == r["records"] and plain.count(b"WARC/1.1\r\nWARC-Type") >= r["records"]


def test_foreign_records():
    body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhello"
    record = b"WARC/1.0\r\nwarc-type:  response\r\nWARC-Target-URI: http://x\r\n /y\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    other = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = list(warc.chunks(io.BytesIO(record + other), 2))
    assert [(r[0], r[1], r[-1]) for r in rows] == [(0, 0, b"he"), (0, 1, b"ll"), (0, 2, b"o"), (1, 0, b"ab"), (1, 1, b"c")]
    assert rows[0][2] == "response" and rows[0][6] == "http://x /y" and rows[0][7] == 5 and rows[2][-3] == b32(b"hello")


@pytest.mark.parametrize("damage", [lambda b: b[:-10], lambda b: b[: len(b) // 2], lambda b: b.replace(b"Content-Length: 32", b"Content-Length: 30"), lambda b: b"x" + b])
def test_damaged_archives_raise(damage):
    body = b"HTTP/1.1 200 OK\r\nXx: 1\r\n\r\nhello!"
    assert len(body) == 32
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 32\r\n\r\n" + body + b"\r\n\r\n"
    list(warc.chunks(io.BytesIO(plain)))
    with pytest.raises(ValueError):
        list(warc.chunks(io.BytesIO(damage(plain))))
    if damage(plain)[:1] == b"W" and len(damage(plain)) < len(plain):
        with pytest.raises(ValueError):
            list(warc.chunks(io.BytesIO(gzip.compress(plain)[:-12])))


def test_lost_archives_are_not_read(pages):
    """What a lost task left behind is not in the list."""
    archives, folder, _ = through(pages)
    store, base = warc._store(folder)
    with store.open_output_stream(f"{base}/left.warc.gz.open", compression=None) as f:
        f.write(b"half")
    assert warc.records(warc.read(archives, folder)).count() == len(PAGES)


def test_no_pages(pages):
    archives, folder, table = through(pages.limit(0))
    assert archives.count() == 0 and table.count() == 0 and warc.records(table).count() == 0


# ---- vector codes


def brute_nearest(rows, book):
    out = []
    for r in rows:
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in book]
        out.append((d.index(min(d)), min(d)))
    return out


@pytest.mark.parametrize("high", [2, 50, 1 << 20, 1 << 40])
def test_partial_distances_find_the_nearest(high):
    rng = random.Random(high)
    for width in (1, 3, 7):
        draw = lambda n, w=width: np.array([[rng.randrange(-high, high) for _ in range(w)] for _ in range(n)], dtype=np.int64)
        book = draw(37)
        book[20] = book[3]
        rows = np.concatenate([draw(200), book])
        codes, errors = vector_codes.nearest(rows, book)
        assert list(zip(codes.tolist(), map(int, errors), strict=True)) == brute_nearest(rows, book)


def test_floors_are_exact():
    x = np.array([0.1, -0.1, 3.4e38, -1e300, 2.0**45 + 0.5, 0.0, 1e-300])
    got = vector_codes.whole(x)
    assert [int(v) for v in got] == [25, -26, int(3.4e38) * 256, -int(1e300) * 256, (2**45) * 256 + 128, 0, 0]
    assert vector_codes.whole(np.array([1.999, -1e-9])).tolist() == [511, -1]
    wide = np.array([[5, -(1 << 70)], [1 << 30, -1]], dtype=object)
    pieces = list(vector_codes._pieces(wide))
    assert [[sum(int(p[i, j]) << (24 * k) for k, p in enumerate(pieces)) for j in (0, 1)] for i in (0, 1)] == wide.tolist()


def brute_codes(rows, parts, entries, rounds, scale=256):
    from fractions import Fraction
    from math import floor

    kept = sorted(((i, [floor(Fraction(float(x)) * scale) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [(i, v + [0] * (-size % parts), label) for i, v, label in kept if len(v) == size]
    w = len(kept[0][1]) // parts
    books = [[v[p * w : (p + 1) * w] for _, v, _ in kept[:entries]] for p in range(parts)]
    assign = lambda: [brute_nearest([v[p * w : (p + 1) * w] for _, v, _ in kept], books[p]) for p in range(parts)]
    for _ in range(rounds):
        for p, found in enumerate(assign()):
            for e in range(len(books[p])):
                mine = [v[p * w : (p + 1) * w] for (_, v, _), (c, _) in zip(kept, found, strict=True) if c == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = assign()
    most = vector_codes.MOST
    errors = [min(most, sum(f[n][1] for f in final)) for n in range(len(kept))]
    sums = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    return books, sorted((str(i), str(label), bytes(f[n][0] for f in final).hex(), errors[n], min(most, sums[label])) for n, (i, _, label) in enumerate(kept))


@pytest.mark.parametrize("size,high", [(16, 1.0), (10, 3.0), (20, 1e30)])
def test_codes_equal_brute_force(spark, size, high):
    rng = random.Random(size)
    vector = lambda: [rng.choice([rng.uniform(-high, high), rng.uniform(-1, 1)]) for _ in range(size)]
    rows = [(i, vector(), i % 3 if i % 4 else None) for i in range(120)]
    rows += [(None, vector(), 1), (5, rows[5][1], 7), (5, vector(), 7), (200, None, 1), (-3, [], 1), (-2, [None, *vector()[1:]], 1), (-1, [float("nan"), *vector()[1:]], 1), (-4, [float("inf"), *vector()[1:]], 1), (300, vector()[1:], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"__id": F.lit(1), "code": F.lit(2), "__vec": F.lit(3), "error": F.lit(0)}).repartition(3)
    books = vector_codes.trained(df, parts=4, entries=16)
    want_books, want = brute_codes(rows, 4, 16, 2)
    assert books.entries.tolist() == want_books
    got = sorted((str(r["vec_id"]), str(r["label"]), r["code"].hex(), r["error"], r["label_error"]) for r in vector_codes.coded(df, books).collect())
    assert got == want
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(x) for p in want_books for e in p for x in e).encode()).hexdigest()


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], "vec_id long, embedding array<float>, label int")
    for df in (none, none.limit(0)):
        books = vector_codes.trained(df)
        assert books is None and vector_codes.coded(df, books).count() == 0 and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_fewer_vectors_than_entries_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 16, 1), (3, [2.0] * 16, None)], "vec_id long, embedding array<float>, label int")
    rows = vector_codes.coded(df, vector_codes.trained(df)).collect()
    assert {(r["vec_id"], r["code"].hex(), r["error"], r["label_error"]) for r in rows} == {(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0), (3, "02" * 16, 0, 0)}


# ---- periodic runs


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= max(6, 4 * q) - q:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def made_words(rng):
    n, k = rng.choice([0, 1, 3, 5, 6, 7, 8, 30, 100, 300]), rng.choice([1, 2, 3, 20])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    while n > 6 and rng.random() < 0.6:
        p, a = rng.randrange(1, max(2, n // 3)), rng.randrange(n)
        for i in range(a + p, rng.randrange(a, n)):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("heavy", [None, 1, 4, 10**9])
def test_runs_equal_brute_force(monkeypatch, heavy):
    """With all words frequent, some, or none."""
    if heavy:
        monkeypatch.setattr(periods, "heavy_from", lambda n: heavy)
    rng = random.Random(heavy)
    texts = [made_words(rng) for _ in range(400)]
    numbers = [periods.numbered(t) for t in texts]
    seen = 0
    for text, number, counts in zip(texts, numbers, periods.lag_counts(numbers), strict=True):
        assert counts.tolist()[1:] == [sum(a == b for a, b in zip(text, text[q:], strict=False)) for q in range(1, len(text) // 4 + 1)]
        found = periods.runs(number, counts)
        assert found == brute_runs(text)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert periods.collapsed(text, found) == " ".join(w for i, w in enumerate(text) if i not in gone)
        seen += len(found)
    assert seen > 100


def test_one_word_and_two_words_at_length():
    for words in (["a"] * 300_000, ["a", "b"] * 100_000, [random.Random(i).choice("ab") for i in range(40_000)]):
        number = periods.numbered(words)
        found = periods.runs(number, periods.lag_counts([number])[0])
        assert found if len(set(words)) == 1 or words[:4] == ["a", "b", "a", "b"] else True
        if len(words) > 100_000:
            assert found == [(0, len(words), len(set(words)))]


def planted(doc_id, words):
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark, sf_dir, docs):
    from quillon.llm.queries import QUERIES

    want = {}
    for r in docs.collect():
        words = planted(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        found = brute_runs(words) if len(words) < 3000 else None
        if found is not None:
            gone = {i for s, n, q in found for i in range(s + q, s + n)}
            best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            want[r["doc_id"]] = (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == docs.count() and want and all(got[i] == w for i, w in want.items())


def test_runs_of_edge_cases(spark, edge, empty):
    rows = periods.periodic(edge).collect()
    assert len(rows) == edge.count() and periods.periodic(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3):
        assert by[i]["n_words"] == 0 and by[i]["runs"] == [] and by[i]["collapsed"] == ""
    assert [tuple(x) for x in by[7]["runs"]] == [(0, 40_000, 1)] and by[7]["collapsed"] == "word"
    assert by[None]["collapsed"] == "null id here" and by[4]["runs"] == []
