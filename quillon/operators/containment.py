"""Which texts hold which others, as an equi join on a part that few of them share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import kept, ship

#: Kinds of keys by their least length: how many bytes a part has, and in how many neighbouring parts one is looked for. All in bytes of UTF-8.
KINDS = ((11, 8, 4), (8, 7, 2), (5, 4, 2), (3, 2, 2), (1, 1, 1))
#: Places of the table of counts, which parts share by their hash: its size never grows, and sharing one makes a part look more frequent, no more.
SLOTS = 1 << 20
#: Counts travel in pieces of so many places.
PIECE = 1 << 12
#: Bytes of keys that a task takes apart at a time.
MOST = 1 << 20
#: Kinds of at most so many small keys are broadcast together; for others both sides are dealt out.
FEW = 300_000
#: The column of ``holders`` with the key that is held.
HELD = "__small"
#: The sieve of parts that are looked for: bits for each small key, marks that a part has, and the least and greatest size as a power of two.
BITS, MARKS, SIEVE = 8, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93), (15, 28)


def _kind(n: Column) -> Column:
    return F.coalesce(*[F.when(n >= least, F.lit(i)) for i, (least, _, _) in enumerate(KINDS)])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch, whose first column are keys, in slices of about ``MOST`` bytes of them: the slice, the keys' bytes and where each begins and ends."""
    keys = batch.column(0).cast(pa.large_binary())
    ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(keys):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + MOST, side="right")) - 1)
        yield batch.slice(low, high - low), data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


def _parts(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of ``width`` bytes of keys, as integers, with the number of their key, and where in that order each key's parts begin."""
    value = np.zeros(max(0, len(data) - width + 1), np.uint64)
    for i in range(width):
        value |= data[i : len(value) + i].astype(np.uint64) << np.uint64(8 * i)
    n = np.maximum(np.diff(ends) - width + 1, 0)
    first = np.append(0, np.cumsum(n))
    row = np.repeat(np.arange(len(n)), n)
    return value[np.arange(first[-1]) - first[row] + ends[row]], row, first


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slot(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(44)).astype(np.int64)


def _rank(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """An order of parts: those of which there are fewer come first."""
    mixed = _mixed(value)
    return counts[_slot(mixed)].astype(np.uint64) << np.uint64(32) | mixed & np.uint64(0xFFFFFFFF)


def _least(rank: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Which parts come first in some ``window`` neighbouring parts of their key; a key with fewer parts has none."""
    n = len(rank) - window + 1
    if n <= 0:
        return np.zeros(len(rank), bool)
    low = rank[:n].copy()
    for i in range(1, window):
        np.minimum(low, rank[i : n + i], out=low)
    whole, out = row[:n] == row[window - 1 :], np.zeros(len(rank), bool)
    for i in range(window):
        out[i : n + i] |= whole & (rank[i : n + i] == low)
    return out


def _counts(keys: DataFrame, kinds: list[int]) -> dict[int, np.ndarray]:
    """How many parts of each kind there are, by place. Tasks send sums, which are added by pieces of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(SLOTS, np.int64) for k in kinds}
        for batch in batches:
            for _, data, ends in _pieces(batch):
                for k in kinds:
                    np.add.at(sums[k], _slot(_mixed(_parts(data, ends, KINDS[k][1])[0])), 1)
        for k in kinds:
            cells = [x.astype("<u4").tobytes() for x in sums[k].reshape(-1, PIECE)]
            some = [i for i, x in enumerate(sums[k].reshape(-1, PIECE)) if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([cells[i] for i in some], pa.binary())], names=["kind", "at", "sums"])

    def added(group: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x, "<u4") for x in group.column("sums").to_pylist()], axis=0, dtype=np.int64)
        return group.slice(0, 1).set_column(2, "sums", pa.array([np.minimum(sums, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary()))

    schema = "kind int, at int, sums binary"
    out = {k: np.zeros(SLOTS, np.uint32) for k in kinds}
    for r in keys.mapInArrow(run, schema).groupBy("kind", "at").applyInArrow(added, schema).collect():
        out[r["kind"]][r["at"] * PIECE : (r["at"] + 1) * PIECE] = np.frombuffer(r["sums"], "<u4")
    return out


def _marks(value: np.ndarray, kind: int, power: int) -> Iterator[np.ndarray]:
    """The places of parts of a kind in a sieve of 2^power bits."""
    mixed = _mixed(value + np.uint64(kind << 56))
    mixed ^= mixed >> np.uint64(32)
    for mark in MARKS:
        yield (mixed * np.uint64(mark) >> np.uint64(64 - power)).astype(np.int64)


def _sieved(sieve: np.ndarray, value: np.ndarray, kind: int) -> np.ndarray:
    """Which parts may be among those that the sieve was made of; none of these is missed."""
    out = np.ones(len(value), bool)
    for at in _marks(value, kind, len(sieve).bit_length() + 2):
        out &= sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
    return out


def _sieve(sought: DataFrame, n: int) -> np.ndarray:
    """A sieve of the parts (__kind, __by) that ``n`` keys look for. Tasks send the pieces that they have marks in, which are joined by piece; its size ends at 2^28 bits,
    beyond which it lets more through, no more."""
    low, high = SIEVE
    power = min(high, max(low, (BITS * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << power - 3, np.uint8)
        for batch in batches:
            kind, value = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for k in np.unique(kind).tolist():
                for at in _marks(value[kind == k], k, power):
                    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        cells = bits.reshape(-1, PIECE)
        some = np.flatnonzero(cells.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([cells[i].tobytes() for i in some], pa.binary())], names=["at", "bits"])

    def joined(group: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("bits").to_pylist()])
        return group.slice(0, 1).set_column(1, "bits", pa.array([bits.tobytes()], pa.binary()))

    out = np.zeros(1 << power - 3, np.uint8)
    for r in sought.select("__kind", "__by").mapInArrow(run, "at int, bits binary").groupBy("at").applyInArrow(joined, "at int, bits binary").collect():
        out[r["at"] * PIECE : (r["at"] + 1) * PIECE] = np.frombuffer(r["bits"], np.uint8)
    return out


def contained(small: DataFrame, small_key: str, big: DataFrame, big_key: str) -> DataFrame:
    """Pairs of rows of which the big key holds the small one; empty and null keys meet nothing. The small rows are kept in the shared folder, so that what they come from
    runs once."""
    rows = kept(small.filter(F.length(small_key) > 0), "small")
    met = holders(rows.select(small_key), big, big_key)
    return rows.join(met, rows[small_key] == met[HELD]).drop(HELD)


def holders(small: DataFrame, big: DataFrame, big_key: str) -> DataFrame:
    """Rows of ``big`` and, in the column ``HELD``, each distinct key among the one column of ``small`` that their key holds; empty and null keys meet nothing.

    A small key looks for the one of its parts of 8 bytes that the fewest big keys have, so that a part that all names share ("GB/T", a year) brings nobody
    together; what meets is then compared in full. A shorter key does so with shorter parts. Parts are counted in a table of ``SLOTS`` places over all big keys,
    which steers the choice alone. A part that comes first in a whole small key comes first in any few neighbours of it, in the big key too: so a big key sends
    only the parts that come first among so many neighbours, only of the kinds that small keys have, and only those that a sieve of the parts looked for lets through.
    While the query is built, the distinct small keys are kept in the shared folder and the big side is read once for the counts; they and the sieve make tables of
    bounded size on the driver and in each task.
    """
    spark, columns = big.sparkSession, big.columns
    ship(spark)
    key = F.col(f"`{small.columns[0]}`")
    keys = kept(small.filter(F.length(key) > 0).select(key.alias(HELD)).distinct().withColumn("__kind", _kind(F.octet_length(HELD))), "contained")
    found = {r["__kind"]: r["count"] for r in keys.groupBy("__kind").count().collect()}
    known = big.filter(F.length(big_key) > 0)
    tables = spark.sparkContext.broadcast(_counts(known.select(F.col(big_key).alias("__big")), sorted(found)) if found else {})

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in _pieces(batch):
                kind, by = part.column(1).to_numpy(), np.zeros(len(part), np.uint64)
                for k in np.unique(kind).tolist():
                    value, row, first = _parts(data, ends, KINDS[k][1])
                    rank, some = _rank(value, tables.value[k]), np.flatnonzero(np.diff(first))
                    low = np.zeros(len(part), np.uint64)
                    low[some] = np.minimum.reduceat(rank, first[some])
                    at = np.flatnonzero((rank == low[row]) & (kind[row] == k))[::-1]
                    by[row[at]] = value[at]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(by.view(np.int64))], names=[HELD, "__kind", "__by"])

    def spread(kinds: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, ends in _pieces(batch):
                    for k in kinds:
                        value, row, _ = _parts(data, ends, KINDS[k][1])
                        at = np.flatnonzero(_least(_rank(value, tables.value[k]), row, KINDS[k][2]))
                        at = at[_sieved(sieve.value, value[at], k)]
                        at = at[np.lexsort((value[at], row[at]))]
                        row, value = row[at], value[at]
                        new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(at)]  # of a part that a key has twice, one
                        row, value = row[new], value[new]
                        yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns[1:], pa.array(np.full(len(row), k, np.int32)), pa.array(value.view(np.int64))], names=[*columns, "__of", "__part"])

        return run

    wanted = lambda kinds: keys.filter(F.col("__kind").isin(kinds)).mapInArrow(sought, f"{HELD} string, __kind int, __by long")
    sieve = spark.sparkContext.broadcast(_sieve(wanted(sorted(found)), sum(found.values())) if found else None)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema)
    met = big.limit(0).withColumn(HELD, F.lit(None).cast("string"))
    few = sorted(k for k in found if found[k] <= FEW)
    for kinds in (few, sorted(set(found) - set(few))):
        if kinds:
            asked = wanted(kinds)
            placed = known.select(F.col(big_key).alias("__big"), *big.columns).mapInArrow(spread(kinds), f"{types}, __of int, __part long")
            pairs = placed.join(F.broadcast(asked) if kinds == few else asked, F.expr("__by = __part and __kind = __of")).filter(F.col(big_key).contains(F.col(HELD)))
            met = met.unionByName(pairs.select(*big.columns, HELD))
    return met
