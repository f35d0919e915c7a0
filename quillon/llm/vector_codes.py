"""Product codes of vectors in exact integer arithmetic, found by partial-distance search.

A vector is cut into parts; each part has a codebook, and a part's code is the index of its nearest entry. Nearest entries are
looked for one dimension at a time, those in which the codebook varies most first: squared differences add up in whole arrays, and
an entry leaves a row's mask once its sum strictly exceeds the best complete distance the row has so far. Which entries leave depends on
exact integers alone, so the result is that of comparing with every entry in full.

Training rounds send sums a codebook entry and dimension from each task, added up by key; the driver holds the codebooks, whose size
follows the dimensions and not the rows. Components may be of any finite size: where products could pass 64 bits, arrays of Python
integers take over, and sums travel in pieces of 24 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, fresh

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a piece of a sum; entries that are compared before the best distances are renewed; rows that are compared at once.
PIECE, BLOCK, AT_ONCE = 24, 16, 4096
MOST = (1 << 63) - 1


class Codebooks(NamedTuple):
    entries: np.ndarray  # (parts, entries, dimensions of a part), of int64 or of Python integers
    size: int  # components of a vector


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers: int64 where all are below 2 ** 52, else Python integers. The scale is a power of two."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < 2.0**52 / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale))
    return np.array([exact(x) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def _safe(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 where distances times entries fit into 62 bits, else both as Python integers."""
    if not (rows.size and book.size):
        return rows, book
    span = int(max(abs(rows.max()), abs(rows.min()))) + int(max(abs(book.max()), abs(book.min())))
    kind = np.int64 if span * span * book.shape[1] * len(book) < 1 << 62 else object
    return rows.astype(kind), book.astype(kind)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each row (ties to the lower index) and the squared distance, by partial distances."""
    n, (k, width) = len(rows), book.shape
    rows, book = _safe(rows, book)
    mean = [sum(int(x) for x in book[:, d]) for d in range(width)]
    spread = [sum((k * int(x) - mean[d]) ** 2 for x in book[:, d]) for d in range(width)]
    order = sorted(range(width), key=lambda d: (-spread[d], d))
    # The entry next to a row in the first dimension gives the row a complete distance to begin with.
    along = np.argsort(book[:, order[0]], kind="stable")
    first = along[np.minimum(np.searchsorted(book[along, order[0]], rows[:, order[0]]), k - 1)]
    apart = rows - book[first]
    best = (apart * apart).sum(axis=1) * k + first  # distance and index in one: the smaller distance, then the smaller index
    for begin in range(0, k, BLOCK):
        entries = book[begin : begin + BLOCK]
        most = best // k
        step = rows[:, order[0], None] - entries[None, :, order[0]]
        partial = step * step
        row, entry = np.nonzero(partial <= most[:, None])
        partial = partial[row, entry]
        for d in order[1:]:
            step = rows[row, d] - entries[entry, d]
            partial = partial + step * step
            stays = np.asarray(partial <= most[row], dtype=bool)
            row, entry, partial = row[stays], entry[stays], partial[stays]
        if len(row):
            key = partial * k + (entry + begin)
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            best[row[heads]] = np.minimum(best[row[heads]], np.minimum.reduceat(key, heads))
    return (best % k).astype(np.int64), best // k


def assigned(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and summed squared distances of whole vectors."""
    parts, _, width = books.shape
    codes, errors = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), object)
    for p in range(parts):
        codes[:, p], distance = nearest(rows[:, p * width : (p + 1) * width], books[p])
        errors += distance
    return codes, errors


def _padded(rows: np.ndarray, parts: int) -> np.ndarray:
    """With zeros behind each vector until the parts are equal; they change no distance."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % parts)))


def _usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.filter((F.size(vec_col) > 0) & F.forall(vec_col, finite))


def _matrix(column: pa.ListArray, parts: int, scale: int) -> np.ndarray:
    return _padded(whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), scale), parts)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _sums(books: np.ndarray, scale: int):
    """Of all rows of a task: for each used entry and dimension, how many parts it got and their sum in pieces of 24 bits."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), np.int64), {}
        for batch in _some(batches):
            rows = _matrix(batch.column(0), parts, scale)
            codes, _ = assigned(rows, books)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
            for piece, digits in enumerate(_pieces(rows)):
                total = totals.setdefault(piece, np.zeros((parts, entries, width), np.int64))
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], digits[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(counts)
        place = ((part * entries + entry)[:, None] * width + np.arange(width)).ravel()
        for piece, total in totals.items():
            columns = [place, np.full(len(place), piece, np.int32), np.repeat(counts[part, entry], width), total[part, entry].ravel()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["place", "piece", "n", "total"])

    return run


def _pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Digits of the integers to base 2 ** 24, lowest first; the highest digit has the sign."""
    while True:
        high = rows >> PIECE
        if not ((high != 0) & (high != -1)).any():
            yield rows.astype(np.int64)
            return
        yield (rows & ((1 << PIECE) - 1)).astype(np.int64)
        rows = high


def trained(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of whole vectors; none where no vector is usable.

    They start as the parts of the vectors with the smallest ids (null ids last, equal ids by their vectors), as many as there are entries or
    rows. A round assigns every part of every vector and moves each entry to the floor of its parts' mean; unused entries stay. Only
    vectors as long as the first one take part.
    """
    usable = _usable(vectors.select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__vec")), "__vec")
    head = usable.orderBy(F.col("__id").asc_nulls_last(), "__vec").limit(1).collect()
    if not head:
        return None
    size = len(head[0]["__vec"])
    usable = usable.filter(F.size("__vec") == size)
    first = usable.orderBy(F.col("__id").asc_nulls_last(), "__vec").limit(entries).collect()
    start = _padded(whole(np.array([r["__vec"] for r in first], dtype=np.float64), scale), parts)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        found = usable.select("__vec").mapInArrow(_sums(books, scale), "place long, piece int, n long, total long")
        sums: dict[int, list[int]] = {}
        for r in found.groupBy("place", "piece").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            both = sums.setdefault(r["place"], [0, 0])
            both[0] = max(both[0], r["n"])
            both[1] += r["total"] << (PIECE * r["piece"])
        moved = books.astype(object).ravel()
        for place, (n, total) in sums.items():
            moved[place] = total // n
        books = moved.reshape(books.shape)
        if np.abs(books).max() < 1 << 52:
            books = books.astype(np.int64)
    return Codebooks(books, size)


def digest(books: Codebooks | None) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and place, joined by commas; without codebooks, of nothing."""
    text = "" if books is None else ",".join(str(int(x)) for x in books.entries.ravel())
    return hashlib.sha256(text.encode()).hexdigest()


def coded(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, code, error, label_error) of every usable vector: its code as one byte a part, its squared distance from what the code
    stands for, and the sum of the distances of all vectors with its label.

    Vectors that are null, empty, or hold null or not finite components have no row, nor have those of another length than the codebooks';
    lengths that do not divide evenly are filled with zeros. Repeated rows are each coded. Null labels count as one label. A distance or
    sum beyond a long is given as the largest long. Other columns are neither read nor returned. An empty table gives an empty result.
    """
    ids = fresh(vectors, "__id", "__label", "__vec")
    usable = _usable(vectors.select(F.col(id_col).alias(ids[0]), F.col(label_col).alias(ids[1]), F.col(vec_col).alias(ids[2])), ids[2])
    kinds = {f.name: f.dataType.simpleString() for f in usable.schema.fields}
    entries, size = books if books is not None else (np.zeros((PARTS, 1, 1), np.int64), -1)
    parts = len(entries)
    if entries.shape[1] > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            codes, errors = assigned(_matrix(batch.column(2), parts, scale), entries)
            code = pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array([min(int(e), MOST) for e in errors], pa.int64())], names=["id", "label", "code", "error"])

    rows = cut(usable.filter(F.size(ids[2]) == size).mapInArrow(run, f"id {kinds[ids[0]]}, label {kinds[ids[1]]}, code binary, error long"))
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")).select(F.col("label").alias("of"), F.least("sum", F.lit(MOST)).cast("long").alias("label_error"))
    # One row a label meets the rows; adaptive execution splits the rows of a label that has too many.
    return rows.join(sums, rows["label"].eqNullSafe(sums["of"])).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error")
