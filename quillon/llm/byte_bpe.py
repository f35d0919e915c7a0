"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has a bucket per merge rank, holding positions in a linked list of parts, and a bitmap in levels of 64-bit
words that marks the buckets in use. Find-first-set, level by level, gives the lowest rank in a handful of steps whatever
the length of the text; entries whose parts have since been merged or changed are stale and skipped when they
surface. The pre-tokens that a batch meets for the first time share one queue, with a gap between them that no merge
crosses; merges in different pre-tokens are independent, so the ids are those of each pre-token on its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices, text_of

#: Pre-tokens whose ids a task remembers; past that it forgets all. Only speed depends on it.
MEMORY = 800_000


class RankQueue:
    """Positions by rank; ``pop`` gives one of the lowest rank. Positions of one rank leave in order of arrival."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        n = ranks
        while True:
            n = (n + 63) >> 6
            self.levels.append([0] * n)
            if n == 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [position])
        else:
            bucket.append(position)

    def fill(self, rank: int, positions: list[int]) -> None:
        """A bucket that is empty gets these positions, and its bits are set."""
        self.buckets[rank] = positions
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            was = level[word]
            level[word] = was | bit
            if was:
                return
            rank = word

    def lowest(self) -> int:
        """The lowest rank in use, -1 if none: find-first-set from the top level down."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        """All positions of a rank; its bucket empties."""
        out = self.buckets.pop(rank)
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word
        return out


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.memory: dict[str, bytes] = {}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.bits = max(ranks.values()).bit_length()
        #: Rank of the token that two adjacent parts make, by both ids in one integer.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[(left << self.bits) | right] = rank
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pairs = np.array([[self.pairs.get((int(a) << self.bits) | int(b), -1) for b in self.single] for a in self.single], dtype=np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers; all pieces share the queue.

        Parts form a linked list, with a gap (id -1) before, between and after the pieces.
        """
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        n = len(data) + len(pieces) + 1
        at = np.arange(1, len(data) + 1) + np.repeat(np.arange(len(pieces)), lengths)
        flat, joined = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        flat[at] = self.single[data]
        inner = np.nonzero(np.diff(at) == 1)[0]
        joined[at[inner]] = self.byte_pairs[data[inner], data[inner + 1]]
        queue, push, pair_rank, bits = self.queue, self.queue.push, self.pairs.get, self.bits
        order = np.nonzero(joined >= 0)[0]
        order = order[np.argsort(joined[order], kind="stable")]
        for group in np.split(order, np.nonzero(np.diff(joined[order]))[0] + 1) if len(order) else ():
            queue.fill(int(joined[group[0]]), group.tolist())
        #: joined[i]: rank of the pair that starts at part i, -1 if it makes no token or i is gone.
        ids, joined, after, before = flat.tolist(), joined.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while (rank := queue.lowest()) >= 0:
            bucket = queue.take(rank)
            bucket.sort()  # of overlapping pairs the leftmost merges first, whenever it came
            left = rank << bits
            for i in bucket:
                if joined[i] != rank:
                    continue  # stale
                j = after[i]
                k, h = after[j], before[i]
                ids[i], ids[j], joined[j] = rank, -2, -1
                after[i], before[k] = k, i
                joined[i] = r = pair_rank(left | ids[k], -1)  # a gap's -1 makes a key that no pair has
                if r >= 0:
                    push(r, i)
                joined[h] = r = pair_rank((ids[h] << bits) | rank, -1)
                if r >= 0:
                    push(r, h)
        final = np.array(ids, dtype=np.int64)
        final = final[final != -2]
        gaps = np.nonzero(final == -1)[0].tolist()
        packed = final.astype("<u4").tobytes()
        return [packed[4 * s + 4 : 4 * e] for s, e in zip(gaps, gaps[1:], strict=False)]

    def encode_texts(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        block, size = [], 0
        for p in {p for pieces in cut for p in pieces}:
            if p in memory:
                continue
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                memory[p] = whole.to_bytes(4, "little")
                continue
            block.append((p, raw))
            size += len(raw)
            if size > 1 << 20:
                memory.update(zip((q for q, _ in block), self.encode_pieces([r for _, r in block]), strict=True))
                block, size = [], 0
        if block:
            memory.update(zip((q for q, _ in block), self.encode_pieces([r for _, r in block]), strict=True))
        for pieces in cut:
            yield b"".join([memory[p] for p in pieces])

    def decode(self, ids: Iterable[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """A coder; a worker keeps it, with the pre-tokens it remembers, for its next tasks."""
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}, pattern)


def coded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (little-endian unsigned 32-bit integers, binary), decoded (bytes that the ids give back).

    Null text counts as empty, with no ids. Repeated rows get equal results; an empty table an empty one; other
    columns are not read. Rows are coded where they are read, without a shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, 1024):
                ids = list(coder.encode_texts(part.column(1).to_pylist()))
                back = [coder.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["__id", "ids", "decoded"])

    narrow = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    return narrow.mapInArrow(run, f"__id {id_type}, ids binary, decoded binary").withColumnRenamed("__id", id_col)
