"""Near copies by SimHash and multi-index hashing, at a bound on the Jaccard similarity of word shingles.

At a similarity of 0.8 two fingerprints differ in about 15 bits of a hundred, too many for balls around 64 bits to be whole. So
fingerprints are wide here: ``SEGMENTS`` segments of 32 bits. In each segment a text enumerates a small Hamming ball, of
radius ``RADIUS`` over the ``UNSURE`` bits whose counts are nearest to a tie: those are the bits in which a near copy differs. Both
texts of a pair enumerate, so they meet in a segment where they differ in up to twice the radius. Whoever meets is verified on the whole distance, then on the
sets of shingles themselves, which alone decide. Two texts at 0.8 exactly meet in some segment with a chance of 98 in a
hundred, at 0.85 of 99.9 (the larger their families, the more chains join them); texts below the bound are never linked.

Two texts of a large table also meet by chance, the more often the more texts there are. So a text leaves a value where no other text is within the whole distance;
such texts are never linked.

Texts with equal sets of shingles are one node from the start. In a large family all would meet all; so texts that
share a ball's value are first compared with one of them (a text with a few of those), and only what these links leave apart is compared in pairs. That is done by
blocks of texts: a family of texts that meet is cut into blocks of a bounded size, and where texts of two blocks meet, the two are brought together once, first
their fingerprints, then the sets of those texts that are near another. Pairs are never rows: what moves is a text for each two blocks, and a group gives back
no more links than join its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, fresh, held, slices, text_of
from quillon.llm.simhash import components

SHINGLE = 5
#: Least similarity of near copies in hundredths.
PERCENT = 80
SEGMENTS, UNSURE, RADIUS = 16, 6, 2
#: Whole distance up to which sets are compared: four deviations above what a similarity of 0.8 gives, twelve below what
#: unrelated texts do.
DISTANCE = 112
#: Neighbours with which a text of a value is compared first, before those that are still near none meet all of the value's texts. A value with more texts, or more pairs left, than these
#: stays whole: to leave it out spares work, no more.
NEIGHBOURS, VALUE_TEXTS, VALUE_PAIRS = 8, 1 << 16, 1 << 24
#: Texts that one is compared with at most before blocks of what is still apart are compared: a text of a large family meets others in each of its balls' values. What that leaves
#: apart, blocks compare.
CENTRES = 4
#: Hashes and texts that a block holds about: two blocks are compared in one go.
BLOCK_HASHES, BLOCK_TEXTS = 150_000, 512
#: Rounds in which texts take the smallest name of those that they meet, before families are cut into blocks by it.
NAMINGS = 2
#: Texts that are compared with their centre in one go at most, about.
STAR_TEXTS = 128
#: A set of keys of at most so many rows is broadcast, and a table of fingerprints of at most so many.
FEW, FEW_PRINTS = 200_000, 50_000
#: Rows that a task reads of a small table, of texts with their fingerprints or sets, and of narrow rows.
TEXTS_A_TASK, ROWS_A_TASK = 2048, 16_384

_POSTS = pa.schema([("node", pa.int64()), ("token", pa.int64()), ("fp", pa.binary())])
_MASKS = np.array([c for r in range(RADIUS + 1) for c in (tuple(x) + (-1,) * (RADIUS - r) for x in combinations(range(UNSURE), r))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. Words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; fewer than
    ``shingle`` words are one whole shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    if not width:
        return h
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set of hashes its segments as unsigned 32-bit integers, and the places of each segment's ``UNSURE`` bits whose counts are
    nearest to half of the set, nearest first."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)) * 256, sizes)
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    counts = np.empty((len(sets), SEGMENTS * 32), np.int64)
    for k in range(SEGMENTS // 2):  # 64 bits at a time, of which each byte is counted by value
        part = _mixed(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            seen = np.bincount(row + part[:, b], minlength=256 * len(sets)).reshape(-1, 256)
            counts[:, 64 * k + 8 * b : 64 * k + 8 * b + 8] = seen @ bits
    margin = (2 * counts - sizes[:, None]).reshape(-1, SEGMENTS, 32)
    values = np.packbits(margin > 0, axis=2, bitorder="little").view("<u4")[:, :, 0]
    return values, np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :UNSURE].astype(np.uint8)


def balls(values: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """All values of each text's balls, led by the segment's number, as 64-bit integers: (texts, values)."""
    flips = np.where(_MASKS >= 0, np.uint32(1) << unsure[:, :, _MASKS.clip(0)].astype(np.uint32), np.uint32(0))
    found = values[:, :, None] ^ np.bitwise_xor.reduce(flips, axis=3)
    return ((np.arange(SEGMENTS, dtype=np.int64) << 32)[None, :, None] | found.astype(np.int64)).reshape(len(values), -1)


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """A narrow row per row: no_id, id, md5 of the text, size and digest of its set of shingles, fp and unsure. The text is read once."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 256, 4_000_000):
                sets = [shingle_hashes(t.as_py(), shingle) for t in part.column(2)]
                values, unsure = fingerprints(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([v.tobytes() for v in values], pa.binary()), pa.array([u.tobytes() for u in unsure], pa.binary()),
                    ],
                    names=["id", "md5", "size", "digest", "fp", "unsure"],
                )

    narrow = docs.select(F.col(id_col).alias("id"), _md5(text_col).alias("md5"), text_of(text_col).alias("text"))
    out = narrow.mapInArrow(run, f"id {id_type}, md5 binary, size long, digest binary, fp binary, unsure binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def _md5(text_col: str) -> Column:
    return F.unhex(F.md5(F.encode(text_of(text_col), "utf-8")))


def _entries(nodes: DataFrame, *names: str) -> DataFrame:
    """``names``, longs, of each node and ``token``, one row for each value of its balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values = np.frombuffer(b"".join(part.column(0).to_pylist()), "<u4").reshape(-1, SEGMENTS)
                unsure = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SEGMENTS, UNSURE)
                tokens = balls(values, unsure)
                repeated = [pa.array(np.repeat(c.to_numpy(), tokens.shape[1])) for c in part.columns[2:]]
                yield pa.RecordBatch.from_arrays([*repeated, pa.array(tokens.ravel())], names=[*names, "token"])

    return nodes.select("fp", "unsure", *names).mapInArrow(run, ", ".join(f"{n} long" for n in (*names, "token")))


def _near_another(token: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of texts sorted by ``token``, with the 64-bit ``words`` of their fingerprints, whether each is within the whole distance of another one of its token."""
    near = np.zeros(len(token), bool)
    for step in range(1, NEIGHBOURS + 1):
        i = np.flatnonzero((token[step:] == token[:-step]) & ~(near[step:] & near[:-step]))
        i = i[np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1, dtype=np.int64) <= DISTANCE]
        near[i] = near[i + step] = True
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    counts = np.diff(np.append(begins, len(token)))
    for begin, n in zip(begins[counts > NEIGHBOURS].tolist(), counts[counts > NEIGHBOURS].tolist(), strict=True):
        left, own = np.flatnonzero(~near[begin : begin + n]), slice(begin, begin + n)
        if len(left) * n > VALUE_PAIRS:
            near[own] = True
            continue
        for x in left.tolist():
            fit = np.bitwise_count(words[own] ^ words[begin + x]).sum(axis=1, dtype=np.int64) <= DISTANCE
            near[own] |= fit & (fit.sum() > 1)  # itself fits
    return near


def _met(posts: DataFrame) -> DataFrame:
    """Of texts with their values and fingerprints (node, token, fp) those that are within the whole distance of another text there: node, token and ``centre``, the first of these
    by a hash of its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, whole = None, (None, None)  # rows of a value that may go on; a value that goes on after a part of it went, and its centre
        for batch in chain(batches, [None]):
            rows = pa.Table.from_batches([b for b in (rest, batch) if b is not None and b.num_rows] or [pa.RecordBatch.from_pydict({"node": [], "token": [], "fp": []}, _POSTS)])
            token, end = rows.column("token").to_numpy(), rows.num_rows
            goes_on = None
            if batch is not None and end:
                last = int(np.searchsorted(token, token[-1]))
                if end - last > VALUE_TEXTS:
                    goes_on = token[-1]
                else:
                    end = last
            rest = rows.slice(end).combine_chunks().to_batches()
            rest = rest[0] if rest else None
            rows, token = rows.slice(0, end), token[:end]
            if not end:
                continue
            node = rows.column("node").to_numpy()
            words = np.frombuffer(b"".join(rows.column("fp").to_pylist()), "<u8").reshape(end, -1)
            kept = _near_another(token, words) | (token == goes_on) | (token == whole[0])
            node, token = node[kept], token[kept]
            _, first, place = np.unique(token, return_index=True, return_inverse=True)
            centre = np.where(token == whole[0], whole[1], node[first][place]) if whole[0] is not None else node[first][place]
            whole = (goes_on, centre[-1]) if goes_on is not None else (None, None)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(token), pa.array(centre.astype(np.int64))], names=["node", "token", "centre"])

    dealt = posts.repartition("token").sortWithinPartitions("token", F.xxhash64("node"), "node")
    return dealt.select("node", "token", "fp").mapInArrow(run, "node long, token long, centre long")


def _token_sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 256, 4_000_000):
                sets = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])

    return texts.mapInArrow(run, "node long, tokens array<bigint>")


def _common(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Of the pairs of two blocks of texts (a, b, a_size, b_size), and the blocks' sets (node, tokens): a, b, and how many hashes the two have in common."""
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    nodes, column = sets.column("node").to_numpy(), sets.column("tokens").combine_chunks()
    order = np.argsort(nodes)
    hashes, ends = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))
    x, y = order[np.searchsorted(nodes, a, sorter=order)], order[np.searchsorted(nodes, b, sorter=order)]
    if len(a) <= 2 * len(nodes):
        n = [len(np.intersect1d(hashes[ends[i] : ends[i + 1]], hashes[ends[j] : ends[j + 1]], assume_unique=True)) for i, j in zip(x, y, strict=True)]
    else:  # many pairs of few texts: all their counts at once, over hashes that two texts have
        _, place, often = np.unique(hashes, return_inverse=True, return_counts=True)
        shared, kept = np.cumsum(often > 1) - 1, often[place] > 1
        owner, at = np.repeat(np.arange(len(nodes)), np.diff(ends))[kept], shared[place[kept]]
        order, width, met = np.argsort(at), 4096, np.zeros((len(nodes), len(nodes)), np.float32)
        for low in range(0, int(shared[-1]) + 1, width):  # some columns at a time
            part = order[slice(*np.searchsorted(at, [low, low + width], sorter=order))]
            held = np.zeros((len(nodes), width), np.float32)
            held[owner[part], at[part] - low] = 1
            met += held @ held.T
        n = met[x, y].astype(np.int64)
    return pa.table({"a": a, "b": b, "a_size": pairs.column("a_size"), "b_size": pairs.column("b_size"), "common": pa.array(n, pa.int64())})


def _with_centre(group: pa.Table, percent: int) -> pa.Table:
    """Of some texts (centre, node, tokens) of one centre, itself among them: a link (a, b) from each at or above the bound to the centre."""
    nodes, column = group.column("node").to_numpy(), group.column("tokens").combine_chunks()
    hashes, ends = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))
    centre = group.column("centre")[0].as_py()
    at = int(np.flatnonzero(nodes == centre)[0])
    own = hashes[ends[at] : ends[at + 1]]
    counts, sizes = np.append(0, np.cumsum(np.isin(hashes, own)))[ends], np.diff(ends)
    good = ((100 + percent) * np.diff(counts) >= percent * (sizes + len(own))) & (nodes != centre)
    return pa.table({"a": nodes[good], "b": np.full(good.sum(), centre, np.int64)})


def _near_pairs(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a group of two blocks (node, size, fp, root, side) that are within the whole distance and the bound on sizes, of different roots, and, where there
    are two blocks, of both."""
    size, root, side = (group.column(c).to_numpy() for c in ("size", "root", "side"))
    bits = np.unpackbits(np.frombuffer(b"".join(group.column("fp").to_pylist()), np.uint8).reshape(len(size), -1), axis=1).astype(np.float32)
    ones = bits.sum(axis=1)
    fit = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T) <= DISTANCE
    fit &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    fit &= root[:, None] != root[None, :]
    if side.any():
        fit &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(fit, 1))


def _held(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    return held(df, rows, cut)


def _keys(df: DataFrame) -> DataFrame:
    """For a join: a table of at most ``FEW`` rows is broadcast, a larger one dealt out."""
    df, n = _held(df, ROWS_A_TASK)
    return F.broadcast(df) if n <= FEW else df


def _dealt(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of pairs of blocks that meet (one, two) and of all blocks (block, hashes, texts): the groups (owner, bin) to which blocks go, and their side there. Of two blocks the larger is the
    owner; the smaller ones that meet it are gathered, about a block's texts at a time, so that it goes once to each bin of them, not once to each of them.
    A block of two texts or more is also compared in itself, alone in a bin."""
    for end in ("one", "two"):
        met = met.join(sizes.select(F.col("block").alias(end), F.struct("hashes", "texts", "block").alias(f"{end}_of")), end)
    met = met.select(F.greatest("one_of", "two_of").alias("o"), F.least("one_of", "two_of").alias("p")).filter("o.block <> p.block").selectExpr("o.block as owner", "p.block as block", "p.hashes", "p.texts")
    met, _ = _held(met, ROWS_A_TASK)
    bins = met.groupBy("owner").agg(F.ceil(F.greatest(F.sum("hashes") / BLOCK_HASHES, F.sum("texts") / BLOCK_TEXTS)).alias("bins"))
    bins = _keys(bins)
    binned = met.join(bins, "owner").select("owner", F.pmod(F.xxhash64("block"), F.col("bins")).alias("bin"), "block", F.lit(1).alias("side"))
    owners = bins.select("owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), F.col("owner").alias("block"), F.lit(0).alias("side"))
    alone = sizes.filter("texts > 1").select(F.col("block").alias("owner"), F.lit(-1).cast("long").alias("bin"), "block", F.lit(0).alias("side"))
    return binned.union(owners).union(alone)


def _by_blocks(posts: DataFrame, prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) between texts of different roots at or above the bound, enough to join all such texts that meet in ``posts`` (node, token, root); ``prints`` has
    their node, size, fp and unsure, ``sets_of`` gives the sets (node, tokens) of some nodes.

    What is asked of all meetings is asked by windows and groups; joins are of texts, blocks and pairs of blocks.
    """
    name = posts.withColumn("name", F.col("node"))
    for _ in range(NAMINGS):
        name = name.withColumn("name", F.expr("min(name) over (partition by token)")).withColumn("name", F.expr("min(name) over (partition by node)"))
    nodes, _ = _held(name.groupBy("node").agg(F.min("name").alias("name"), F.min("root").alias("root")).join(prints, "node"), TEXTS_A_TASK)
    blocks = _keys(nodes.groupBy("name").agg(F.ceil(F.greatest(F.sum("size") / BLOCK_HASHES, F.count(F.lit(1)) / BLOCK_TEXTS)).alias("blocks")).filter("blocks > 1"))
    block = F.xxhash64("name", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    placed = nodes.join(blocks, "name", "left").withColumn("block", block).drop("name", "blocks")
    # A text's block stands beside its values for a moment, so that a window tells it to them; what is kept are the few sets of blocks that share a value.
    none = F.lit(None).cast("long")
    marked = posts.select("node", "token", "root", none.alias("block")).unionByName(placed.select("node", none.alias("token"), "root", "block"))
    marked = marked.withColumn("block", F.expr("max(block) over (partition by node)")).filter("token is not null")
    met = marked.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array_sort(F.collect_set("block")).alias("met"))
    met = met.filter("low < high").select("met").distinct()
    ends = met.withColumn("one", F.explode("met")).withColumn("two", F.explode(F.filter("met", lambda b: b >= F.col("one"))))
    met = _keys(ends.select("one", "two").distinct())
    sizes = _keys(placed.groupBy("block").agg(F.sum("size").alias("hashes"), F.count(F.lit(1)).alias("texts")))
    dealt = _keys(_dealt(met, sizes))
    keyed = placed.join(dealt, "block").select(F.col("owner").alias("one"), F.col("bin").alias("two"), "node", "size", "fp", "root", "side")

    def near(group: pa.Table) -> pa.Table:
        some = np.unique(np.concatenate(_near_pairs(group, percent)))
        return group.take(pa.array(some))

    def joined(group: pa.Table) -> pa.Table:
        i, j = _near_pairs(group, percent)
        node, size = (group.column(c).to_numpy() for c in ("node", "size"))
        got = _common(pa.table({"a": node[i], "b": node[j], "a_size": size[i], "b_size": size[j]}), group.select(["node", "tokens"])).column("common").to_numpy()
        good = (100 + percent) * got >= percent * (size[i] + size[j])
        root = list(range(len(node)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for a, b in zip(i[good].tolist(), j[good].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:  # a link that others of the group already make is left out
                root[x] = y
                out.append((min(node[a], node[b]), max(node[a], node[b])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    close, n = _held(keyed.groupBy("one", "two").applyInArrow(near, keyed.schema), TEXTS_A_TASK)
    ends = close.select("node")
    whole = close.join(sets_of(F.broadcast(ends) if n <= FEW else ends), "node")
    return cut(whole.groupBy("one", "two").applyInArrow(joined, "a long, b long"))


def links(docs: DataFrame, nodes: DataFrame, text_col: str, percent: int, shingle: int) -> DataFrame:
    """Links (a, b) between ``nodes`` (node, md5, size, fp, unsure): each joins two texts at or above the bound, and two such texts that
    meet in a segment are joined by a chain of links."""
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets reach the bound only as equals
    wide, n = _held(nodes.filter(F.col("size") >= least), TEXTS_A_TASK)
    # Values of one text alone leave where they are counted; only the others get fingerprints.
    posts = _entries(wide, "node").repartition("token").withColumn("n", F.expr("count(1) over (partition by token)")).filter("n > 1")
    prints = wide.select("node", "fp")
    posts = cut(_met(posts.join(F.broadcast(prints) if n <= FEW_PRINTS else prints, "node")))
    bits = " + ".join(f"bit_count(a_fp[{i}] ^ b_fp[{i}])" for i in range(SEGMENTS // 2))
    words = F.array(*(F.conv(F.hex(F.substring("fp", 8 * i + 1, 8)), 16, -10).cast("long") for i in range(SEGMENTS // 2)))

    def sets_of(ends: DataFrame) -> DataFrame:
        """The sets of some nodes. Texts come back by their md5; those that share one are the same text."""
        wanted = _keys(wide.join(ends, "node", "left_semi").select("node", "md5"))
        texts = docs.select(_md5(text_col).alias("md5"), text_of(text_col).alias("text")).join(wanted, "md5").select("node", "text")
        return _held(_token_sets(texts, shingle).dropDuplicates(["node"]), TEXTS_A_TASK)[0]

    # Of the texts that others of its meetings are compared with, a text is compared with those that come first for all.
    first = posts.filter("node <> centre").groupBy("node").agg(F.array_sort(F.collect_set(F.struct(F.xxhash64("centre").alias("place"), "centre"))).alias("c"))
    pairs = first.select(F.col("node").alias("a"), F.explode(F.slice("c", 1, CENTRES)).alias("c")).select("a", F.col("c.centre").alias("b"))
    for end in ("a", "b"):
        prints = wide.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), words.alias(f"{end}_fp"))
        pairs = pairs.join(F.broadcast(prints) if n <= FEW_PRINTS else prints, end)
    # Pairs within the whole distance and the bound on sizes.
    close = pairs.filter(f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size) and {bits} <= {DISTANCE}").select("a", "b", "a_size", "b_size")
    pairs, n = _held(close, ROWS_A_TASK)
    # A centre goes once to each part of its texts; so a large star has many small parts.
    parts = _keys(pairs.groupBy("b").agg(F.ceil(F.greatest(F.sum("a_size") / BLOCK_HASHES, F.count(F.lit(1)) / STAR_TEXTS)).alias("parts")).filter("parts > 1"))
    keyed = pairs.join(parts, "b", "left").select(F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"), "a")
    both = keyed.select("centre", "part", F.explode(F.array("a", "centre")).alias("node"))
    ends = both.select("node")
    members = both.distinct().join(sets_of(F.broadcast(ends) if n <= FEW else ends), "node")
    found, n = _held(members.groupBy("centre", "part").applyInArrow(lambda group: _with_centre(group, percent), "a long, b long"), ROWS_A_TASK)

    roots = components(found).selectExpr("node as linked", "root")
    named = posts.join(F.broadcast(roots) if n <= FEW else roots, posts["node"] == roots["linked"], "left").select("node", "token", F.coalesce("root", "node").alias("root"))
    # A value whose texts are all joined has done its work.
    ends = named.withColumn("low", F.expr("min(root) over (partition by token)")).withColumn("high", F.expr("max(root) over (partition by token)"))
    apart = cut(ends.filter("low < high").select("node", "token", "root"))
    return found.union(_by_blocks(apart, wide.select("node", "size", "fp", "unsure"), sets_of, percent))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of near copies, with its own columns: the one with the smallest id, null ids last.

    Null text counts as empty; texts with equal sets of shingles, empty ones among them, are near copies of each other. Very long
    texts count whole. Verdicts are of rows, known by their id and the md5 of their text: rows with a null or repeated id
    lose no other row; of rows that repeat both, the one stays whose columns, written as JSON, come first. Columns of any name pass. An empty table gives an empty result.
    """
    rows = cut(_signed(docs, id_col, text_col, shingle))
    classes = rows.groupBy("digest").agg(F.min("row").alias("row"))
    nodes = rows.join(classes, ["digest", "row"]).select(F.col("row").alias("node"), "md5", "size", "fp", "unsure")
    named = rows.select("id", "md5", "digest").join(classes.select("digest", F.col("row").alias("node")), "digest").select("id", "md5", "node")
    found = components(links(docs, nodes, text_col, percent, shingle)).withColumnRenamed("node", "linked")
    named = named.join(found, named["node"] == found["linked"], "left").select("id", "md5", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("md5").alias("md5"))
    rows, _ = _held(named.groupBy("root", "id", "md5").agg(F.count(F.lit(1)).alias("n")), ROWS_A_TASK)
    first = rows.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("kinds"))
    # What leaves, and what stays once though its row repeats; all other rows pass as they are.
    verdicts = rows.join(first, "root").withColumn("stays", F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.md5") == F.col("md5"))).filter("not stays or n > 1")
    key, known, stays, row = fresh(docs, "__key", "__known", "__stays", "__row")
    sign = lambda id_name, md5: F.struct(F.col(id_name).isNull().alias("no_id"), F.coalesce(F.xxhash64(id_name), F.lit(0)).alias("id"), md5.alias("md5"))
    verdicts = _keys(verdicts.select(sign("id", F.col("md5")).alias(known), F.col("stays").alias(stays)))
    keyed = docs.withColumn(key, sign(id_col, _md5(text_col)))
    passing = keyed.join(verdicts, F.col(key) == F.col(known), "left_anti").select(docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = keyed.join(verdicts.filter(stays), F.col(key) == F.col(known)).groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return passing.unionByName(once)
