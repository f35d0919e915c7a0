"""SimHash near-duplicates by multi-index hashing, and their connected components.

Fingerprints are computed per row. Distinct fingerprints then go into one table per segment (two halves of 32
bits): two fingerprints within 3 bits agree up to 1 bit in at least one half, so each fingerprint looks up the
33 values of the radius-1 ball around each of its halves and every hit is verified on all 64 bits. Exact copies and
repeated texts share a fingerprint and never meet as pairs. Components come from large-star/small-star rounds on the
links between distinct fingerprints, each cut by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, first_rows, held, row_order, text_of, with_row_key

SEED = 42
DISTANCE = 3
SHINGLE = 3
#: Edges that one task joins by itself; a graph of more takes rounds of joins.
EDGES = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set where over half of the shingles' hashes have it; no words: 0."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, only \x20 and \x09-\x0D split
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    counts, step = np.zeros(64, dtype=np.int64), 1 << 16
    for i in range(0, len(grams), step):  # blocks keep the bit matrix small for very long texts
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[i : i + step]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and ``fp``, the fingerprint as a signed long. Null text counts as empty."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["__id", "__fp"])

    narrow = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    return narrow.mapInArrow(run, f"__id {id_type.simpleString()}, __fp long").select(F.col("__id").alias(id_col), F.col("__fp").alias("fp"))


def _ball(half: Column) -> Column:
    """A 32-bit segment value and its 32 neighbours at one bit."""
    return F.concat(F.array(half), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: half.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs a < b of the distinct values of ``fp`` at 1 to ``distance`` (at most 3) differing bits."""
    assert 0 < distance <= 3, "two halves with a ball of radius 1 are whole for at most 3 bits"
    halves = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value")),
        F.struct(F.lit(1).alias("part"), F.shiftrightunsigned("fp", 32).alias("value")),
    )).alias("s")).select("fp", "s.part", "s.value")
    probes = halves.select(F.col("fp").alias("a"), "part", F.explode(_ball(F.col("value"))).alias("value"))
    table = halves.select(F.col("fp").alias("b"), "part", "value")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return probes.join(table, ["part", "value"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (u, v) of a task, one from each node to the smallest node of its component there, if that is another one."""
    got = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    names, ends = np.unique(np.concatenate(got, axis=1) if got else np.empty((2, 0), np.int64), return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in ends.reshape(2, -1).T.tolist():
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    low = np.array([find(x) for x in range(len(names))], np.int64)
    u = np.flatnonzero(low != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[low[u]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of an edge (a, b) of longs.

    Each task first joins its own edges, at most about ``EDGES``, into stars; what keeps the components has fewer edges then. Where no more than
    ``EDGES`` are left, one task ends the work; else rounds do: alternating large-star and small-star: both keep the components and move edges towards the smallest
    neighbour; the rounds grow with the logarithm of the nodes. A neighbourhood is reduced to its minimum by a
    partially aggregated group and met again by a join that adaptive execution may split, so a hub with very
    many edges is never gathered into one task.
    """
    now, n = held(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")), EDGES)
    now, n = held(now.mapInArrow(_forest, "u long, v long"), EDGES)
    before = None
    while n > EDGES:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now, n = held(small.filter("u <> v").distinct(), EDGES)
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        now = cut(now.mapInArrow(_forest, "u long, v long"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null and empty texts have fingerprint zero and link like any other. Texts shorter than a shingle count as one
    whole shingle. Repeated rows share fingerprint and component. A null id never names a component unless
    all ids in it are null. An empty table gives an empty result; other columns are not read.
    """
    fps = cut(with_fingerprint(docs, id_col, text_col, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("__first")))
    found = components(links(classes.select("fp"), distance))
    linked = found.join(classes, found["node"] == classes["fp"]).select("node", "root", "__first")
    lowest = linked.groupBy("root").agg(F.min("__first").alias("__low"))
    named = linked.join(lowest, "root").select(F.col("node").alias("fp"), "__low")
    # Cut, so that the last join is one of two plain exchanges and a hot fingerprint's rows can be split.
    by_fp = cut(classes.join(named, "fp", "left").select("fp", F.coalesce("__low", "__first").alias("component_id")))
    return fps.join(by_fp, "fp").select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of near copies, with its own columns: the one with the smallest id, null ids last. Verdicts
    are of rows, so null and repeated ids take no other row with them."""
    keyed, row = with_row_key(docs)
    fps = cut(with_fingerprint(keyed.select(row_order(id_col, row).alias("key"), F.col(text_col).alias("text")), "key", "text", shingle))
    found = components(links(fps.select("fp").distinct(), distance))
    return first_rows(keyed, row, fps.join(found, fps["fp"] == found["node"], "left").select("key", F.coalesce("root", "fp").alias("root")))
