"""Language-model scoring by a weighted backoff automaton over words.

The model is an n-gram of order 3 with Dirichlet smoothing at each order, p(w | h) = (c(h, w) + K p(w | h')) / (c(h) + K) where h' is h
without its first word, over additively smoothed unigrams. As an automaton: each history seen in training (two words, one,
none) is a state; a seen n-gram is an arc from its history, which carries log10 p and leads to the longest seen history that
ends there; a failure arc carries log10 (K / (c(h) + K)) and leads to h'. One left-to-right traversal of a text carries
the state and adds up the weights of the arcs it takes, falling along as many failure arcs as it must at each word.

Counts cover the whole training corpus. The model grows with them, so no task holds it whole: texts are coded in chunks of
bounded size, and a chunk builds the part of the automaton that its own texts can reach. A chunk sends each hash bucket a sorted
array of the distinct n-gram hashes it has, with training counts; a bucket adds up the counts of all chunks and answers each in the
same order. What travels is a few bytes a distinct n-gram and chunk, packed in numpy arrays. N-grams are spread over the buckets
by hash, so a frequent word's n-grams are spread too, and the most frequent n-gram counts once a chunk. The number of
buckets follows the corpus, so that a bucket's size does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, shared_folder, text_of

#: Bytes of text after which a chunk ends; a task's memory grows with this and the longest text, not with the table. A chunk sends each bucket
#: of an order one row, so for corpora of very many terabytes chunks are to be larger as well.
CHUNK_BYTES = 10_000_000
ORDER = 3
#: Weight of the next lower order in each context of one and of two words, in tokens; of those tried the best on held-out text.
PRIORS = (300.0, 10.0)
#: N-grams of a bucket, counted once a chunk.
BUCKET_KEYS = 1_000_000
#: Tokens that are read in one go; a longer text is cut, and a cut regains its state from the words before it.
SEGMENT = 512
#: Buckets of the table of chunks, as many as Spark allows; beyond, a bucket holds several chunks, which are taken one at a time.
MOST_BUCKETS = 100_000
END, BEGIN = 1, 2  # hashes of the marks at a text's end and beginning
ADDED = 0.1
#: N-grams of two and three words travel as so many bits of their hashes. Of unseen ones, as many in 2 ** 56 as the corpus has distinct ones are
#: taken for another: at 10 ** 9, one in 70 million.
GRAM_BITS = 56


def tokens(text: str) -> np.ndarray:
    """64-bit hashes of the words, ASCII letters lower-cased, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of each element among them, and the number of one element for each."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], place, order[new].astype(np.int32)


class Chunk:
    """The tokens of some texts as places among their distinct words, and each token's place among the distinct n-grams that end there.

    ``words`` are the sorted hashes of the distinct words and the begin, ``word`` the place of each token among them."""

    def __init__(self, words: np.ndarray, word: np.ndarray, lengths: np.ndarray, order: int = ORDER) -> None:
        self.words, self.word, self.lengths = words, word, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.begin = int(np.searchsorted(words, np.uint64(BEGIN)))
        self.context = np.empty_like(word)
        self.context[1:] = word[:-1]
        self.context[self.starts] = self.begin
        #: Sorted hashes of each order's distinct n-grams, and, but for single words: tokens at which one ends, their places, and one token for each.
        self.grams: list[np.ndarray] = [words]
        self.ends: list[tuple[slice | np.ndarray, np.ndarray, np.ndarray]] = []
        if order > 1:
            pair = _mix(words[self.context], words[word])
            found, place, one = _distinct(pair >> np.uint64(64 - GRAM_BITS))
            self.grams.append(found)
            self.ends.append((slice(None), place, one))
        if order > 2:
            late = np.ones(len(word), bool)
            late[self.starts] = False  # a text's first token has only the begin before it
            late = np.nonzero(late)[0].astype(np.int32)
            found, place, one = _distinct(_mix(pair[late - 1] ^ np.uint64(0x5851F42D4C957F2D), words[word[late]]) >> np.uint64(64 - GRAM_BITS))
            self.grams.append(found)
            self.ends.append((late, place, late[one]))

    @classmethod
    def of(cls, texts: list[np.ndarray], order: int = ORDER) -> Chunk:
        words, place, _ = _distinct(np.concatenate([*texts, np.array([BEGIN], np.uint64)]))
        return cls(words, place[:-1], np.array([len(t) for t in texts], dtype=np.int64), order)

    def counted(self, training: np.ndarray) -> list[np.ndarray]:
        """Training counts of each order's n-grams; the begin counts training texts."""
        mine = np.repeat(training, self.lengths)
        first = np.bincount(self.word[mine], minlength=len(self.words))
        first[self.begin] += int(training.sum())
        return [first, *(np.bincount(place[mine[at]], minlength=len(grams)) for grams, (at, place, _) in zip(self.grams[1:], self.ends, strict=True))]


class Automaton:
    """The part of the model that a chunk's texts can reach. States are numbered: -1 the empty history, then words, then pairs of words."""

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], total: int, vocabulary: int, priors: tuple[float, ...] = PRIORS) -> None:
        n, c1 = len(chunk.words), counts[0]
        self.n, self.begin = n, chunk.begin if c1[chunk.begin] else -1
        self.single = np.log10((c1 + ADDED) / (total + ADDED * (vocabulary + 1)))
        self.to_single = np.where(c1 > 0, np.arange(n), -1)
        self.orders = len(counts)
        #: For each order above 1: arcs by (state, word), sorted; their weights and where they lead; the failure arcs' weights and ends.
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fail: list[tuple[np.ndarray, np.ndarray]] = []
        lower, history = self.single, c1  # log p of the lower order and count of the history, for each history
        if self.orders > 1:
            _, _, one = chunk.ends[0]
            u, w, c2 = chunk.context[one], chunk.word[one], counts[1]
            p2 = np.log10((c2 + priors[0] * 10 ** lower[w]) / (history[u] + priors[0]))
            # With order 2 no pair is a state, and arcs lead to single words.
            self._add(u, w, c2 > 0, p2, n + np.arange(len(w)) if self.orders > 2 else w)
            self.fail.append((np.log10(priors[0] / (history + priors[0])), np.full(n, -1)))
        if self.orders > 2:
            _, _, at = chunk.ends[1]
            pair_at = chunk.ends[0][1]
            h, w3, v, c3 = pair_at[at - 1], chunk.word[at], pair_at[at], counts[2]
            p3 = np.log10((c3 + priors[1] * 10 ** p2[v]) / (c2[h] + priors[1]))
            self._add(h, w3, c3 > 0, p3, n + v)
            self.fail.append((np.log10(priors[1] / (c2 + priors[1])), w))

    def _add(self, state: np.ndarray, word: np.ndarray, seen: np.ndarray, weight: np.ndarray, to: np.ndarray) -> None:
        seen = np.flatnonzero(seen)
        key = state[seen].astype(np.int64) * self.n + word[seen]
        order = np.argsort(key)
        seen = seen[order]
        self.arcs.append((key[order], weight[seen], to[seen]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights taken and states reached when each state reads a word."""
        weight, reached = np.zeros(len(state)), np.full(len(state), -2, np.int64)
        for order in range(self.orders, 1, -1):
            base = self.n if order == 3 else 0
            here = np.nonzero((state >= base) & (reached == -2))[0]
            if not len(here):
                continue
            keys, weights, to = self.arcs[order - 2]
            key = (state[here] - base) * self.n + word[here]
            at = np.searchsorted(keys, key)
            hit = np.zeros(len(here), bool)
            inside = at < len(keys)
            hit[inside] = keys[at[inside]] == key[inside]
            weight[here[hit]] += weights[at[hit]]
            reached[here[hit]] = to[at[hit]]
            falling = here[~hit]
            loss, next_state = self.fail[order - 2]
            weight[falling] += loss[state[falling] - base]
            state[falling] = next_state[state[falling] - base]
        rest = reached == -2
        weight[rest] += self.single[word[rest]]
        reached[rest] = self.to_single[word[rest]]
        return weight, reached

    def traverse(self, chunk: Chunk, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of each text. Texts are read side by side, long ones in segments; a segment within a text first reads the words
        that make its state."""
        pieces = -(-chunk.lengths // segment)
        text = np.repeat(np.arange(len(pieces)), pieces)
        part = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = chunk.starts[text] + part * segment
        end = np.minimum(begin + segment, (chunk.starts + chunk.lengths)[text])
        warm = np.where(part > 0, min(2, self.orders - 1), 0)
        at, length = begin - warm, end - begin + warm
        order = np.argsort(-length, kind="stable")
        text, at, length, warm = text[order], at[order], length[order], warm[order]
        state, total = np.where(warm > 0, -1, self.begin if self.orders > 1 else -1), np.zeros(len(text))
        active = np.searchsorted(-length, -np.arange(1, length.max(initial=0) + 1), side="right")
        for t, k in enumerate(active.tolist()):
            weight, state[:k] = self.step(state[:k].copy(), chunk.word[at[:k] + t])
            total[:k] += np.where(warm[:k] > t, 0.0, weight)
        return np.bincount(text, weights=total, minlength=len(pieces))


def _bounds(sorted_hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the hash space of ``bits`` begins and ends in a sorted array."""
    step = (1 << bits) // n
    return np.append(np.searchsorted(sorted_hashes, np.array([step * i for i in range(n)], dtype=np.uint64)), len(sorted_hashes))


def _zip(x: np.ndarray) -> bytes:
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their differences, most significant planes together: these hold little and compress well."""
    return _zip(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = _unzip(packed).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2, 4 or 8 bytes, led by that width."""
    top = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + _zip(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)


def _wide(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unzip(packed[1:]).reshape(packed[0], -1).T).view(f"<u{packed[0]}").ravel().astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Slices of the task's rows by chunk number."""
    number, size, held = TaskContext.get().partitionId() << 32, 0, []
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        begin = 0
        for i, n in enumerate(lengths.tolist()):
            size += n
            if size >= limit:
                held.append(batch.slice(begin, i + 1 - begin))
                yield number, held
                number, size, held, begin = number + 1, 0, [], i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield number, held


def _coded(docs: DataFrame, training: Column, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """One row a chunk: chunk, n (its tokens), ids, train, lengths, words (distinct hashes) and word (each token's place among them); and the
    number of buckets by chunk in which they are written, in the shared folder.

    The chunks are read twice: to ask, and, where their buckets lie, to meet the answers, so that they are never shuffled.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _chunks(batches, chunk_bytes):
            c = Chunk.of([tokens(t.as_py()) for p in parts for t in p.column(1)], 1)
            # Frequent words first, by powers of two, so that places are small numbers and compress well.
            order = np.argsort(-np.frexp(np.bincount(c.word, minlength=len(c.words)))[1], kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            train = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts]).astype(np.uint8)
            ids = pa.concat_arrays([p.column(0) for p in parts])
            packed = (_zip(train), _zip(c.lengths.astype("<u4")), _packed(c.words[order]), _zip(place[c.word].astype("<u4").view(np.uint8).reshape(-1, 4).T))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(c.word)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in packed)],
                names=["chunk", "n", "ids", "train", "lengths", "words", "word"],
            )

    narrow = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"), F.coalesce(training, F.lit(False)).alias("__train"))
    coded = narrow.mapInArrow(run, f"chunk long, n long, ids array<{id_type}>, train binary, lengths binary, words binary, word binary")
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    n, name = min(1 + size // chunk_bytes, MOST_BUCKETS), f"coded_chunks_{uuid4().hex}"
    coded.write.option("path", f"{shared_folder(spark)}/{name}").bucketBy(n, "chunk").format("parquet").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # leaves the catalogue; the files stay, and the table read is known by them
    return written, n


def _read(row: dict, order: int) -> tuple[Chunk, np.ndarray]:
    """A chunk and its training flags from a row of ``_coded``."""
    words = _unpacked(row["words"])
    by_hash = np.argsort(words)
    place = np.empty(len(words), np.int32)
    place[by_hash] = np.arange(len(words), dtype=np.int32)
    word = np.ascontiguousarray(_unzip(row["word"]).reshape(4, -1).T).view("<u4").ravel()
    return Chunk(words[by_hash], place[word], _unzip(row["lengths"]).view("<u4").astype(np.int64), order), _unzip(row["train"]).astype(bool)


def scores(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, order: int = ORDER, priors: tuple[float, ...] = PRIORS, bucket_keys: int = BUCKET_KEYS
) -> DataFrame:
    """One row per row of ``docs``: id, training, n_tokens, n_known, train_tokens, base_score, score.

    Learns n-grams up to ``order`` (1 to 3) from the rows where ``training`` holds, scores all. Null text counts as empty and has
    one token, its end. Repeated rows count as often as they occur; null and repeated ids pass. An empty table gives an empty
    result; other columns are not read. Coded chunks are kept in the shared folder.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    coded, n_parts = _coded(docs, training, id_col, text_col, chunk_bytes)
    n_tokens = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = max(1, -(-n_tokens // bucket_keys))  # for each order

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk, train = _read(row, order)
                for kind, (keys, counts) in enumerate(zip(chunk.grams, chunk.counted(train), strict=True)):
                    at = _bounds(keys, n_buckets, GRAM_BITS if kind else 64)
                    spans = [(b, s, e) for b, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > s]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind * n_buckets + b for b, _, _ in spans], pa.int64()),
                            pa.array([row["chunk"]] * len(spans), pa.int64()),
                            pa.array([_packed(keys[s:e]) for _, s, e in spans], pa.binary()),
                            pa.array([_small(counts[s:e]) for _, s, e in spans], pa.binary()),
                        ],
                        names=["bucket", "chunk", "keys", "counts"],
                    )

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        asked = [(c, _unpacked(k), _wide(n)) for c, k, n in zip(*(group.column(x).to_pylist() for x in ("chunk", "keys", "counts")), strict=True)]
        keys, inverse = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([n for _, _, n in asked]), minlength=len(keys)).astype(np.int64)
        words = (keys != BEGIN) if key[0].as_py() < n_buckets else np.zeros(len(keys), bool)
        n, v, at = int(total[words].sum()), int((total[words] > 0).sum()), 0
        replies = []
        for _, k, _ in asked:
            replies.append(_small(total[inverse[at : at + len(k)]]))
            at += len(k)
        once = [1] + [0] * (len(asked) - 1)
        return pa.table({
            "chunk": pa.array([c for c, _, _ in asked], pa.int64()),
            "bucket": pa.array([key[0].as_py()] * len(asked), pa.int64()),
            "counts": pa.array(replies, pa.binary()),
            "n": pa.array([n * x for x in once], pa.int64()),
            "v": pa.array([v * x for x in once], pa.int64()),
        })

    # About four buckets, and about one chunk, a partition: what a task reads does not grow with the corpus.
    asked = coded.select("chunk", "train", "lengths", "words", "word").mapInArrow(ask, "bucket long, chunk long, keys binary, counts binary").repartition(-(-order * n_buckets // 4), "bucket")
    answers = cut(asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, counts binary, n long, v long"))
    sums = answers.agg(F.sum("n"), F.sum("v")).first()
    total, vocabulary = int(sums[0] or 0), int(sums[1] or 0)

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk, train = _read(row, order)
        found = _wide_all([c for _, c in sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))])
        counts = np.split(found, np.cumsum([len(g) for g in chunk.grams])[:-1])
        model = Automaton(chunk, counts, total, vocabulary, priors)
        add = lambda x: np.add.reduceat(x, chunk.starts)
        return pa.table({
            "__id": left.column("ids").combine_chunks().flatten(),
            "training": pa.array(train),
            "n_tokens": pa.array(chunk.lengths),
            "n_known": pa.array(add((counts[0][chunk.word] > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(train), total, np.int64)),
            "base_score": pa.array(add(model.single[chunk.word])),
            "score": pa.array(model.traverse(chunk)),
        })

    back = answers.select("chunk", "bucket", "counts").repartition(n_parts, "chunk")
    out = coded.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        walk, f"__id {id_type}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumnRenamed("__id", id_col)


def _wide_all(packed: list[bytes]) -> np.ndarray:
    return np.concatenate([_wide(p) for p in packed])
