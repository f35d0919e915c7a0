"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and packed where their scan partition is read, so no token is shuffled. Within a task,
documents gather into groups of bounded size; a group's long documents give full windows, the rest is cut into pieces
and divided among windows by multiway differencing: partial partitions with opposing imbalances are merged until one is
left, which makes the windows nearly equal. Where the fullest window exceeds the capacity, the window count rises and
the differencing runs again.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_of

CAPACITY = 2048
#: Tokens that a task gathers before it packs them; bounds its memory unless one document is larger.
GROUP_TOKENS = 1 << 20
#: Longest piece of a document's rest. Smaller pieces balance better and cut documents more often.
PIECE = 512
END = 1


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers in ``ways`` sets whose sums are nearly equal.

    Each item starts as a partial partition of its own. The imbalance of a partial partition is its largest sum less its smallest;
    the two with the largest imbalances are merged, largest sum against smallest, until one is left. Only sums above zero
    are held, in ascending order: where two partial partitions have no more than ``ways`` of them together, none meet.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    # Nested pairs instead of joined lists: each merge costs a step per sum, whatever the sets hold.
    heap: list[tuple[int, int, list[tuple[int, list]]]] = [(-sizes[i] if ways > 1 else 0, n, [(sizes[i], [i])]) for n, i in enumerate(order)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        meet = max(0, len(a) + len(b) - ways)
        met = [(x[0] + y[0], [x[1], y[1]]) for x, y in zip(a[:meet], reversed(b[:meet]), strict=True)]
        if len(b) == 1:
            merged = a[meet:]
            bisect.insort(merged, met[0] if meet else b[0], key=_sum)
        else:
            merged = sorted([*a[meet:], *b[meet:], *met], key=_sum)
        heapq.heappush(heap, ((merged[0][0] if len(merged) == ways else 0) - merged[-1][0], n, merged))
        n += 1
    sets = [_flat(items) for _, items in heap[0][2]] if heap else []
    return sets + [[] for _ in range(ways - len(sets))]


def _sum(part: tuple[int, list]) -> int:
    return part[0]


def _flat(nested: list) -> list[int]:
    out, stack = [], [nested]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(x)
        else:
            out.append(x)
    return sorted(out)


def pack(lengths: list[int], capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) for each piece; windows hold at most ``capacity``.

    Full windows are cut from the front of long documents; what is left of a document is cut into pieces of ``piece`` and a last,
    shorter one.
    """
    out, rests, window = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, window, 0))
            window += 1
        if n > full * capacity:
            for at in range(full * capacity, n, piece):
                rests.append((d, at, min(piece, n - at)))
    if not rests:
        return out
    sizes = [r[2] for r in rests]
    ways = -(-sum(sizes) // capacity)
    while True:
        sets = differencing(sizes, ways)
        if max(sum(sizes[i] for i in s) for s in sets) <= capacity:
            break
        ways += 1 + ways // 1024
    for s in sets:
        at = 0
        for i in s:
            d, start, size = rests[i]
            out.append((d, start, size, window, at))
            at += size
        window += bool(s)
    return out


def byte_bpe_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under a byte-level BPE file of the tokenizers library: those of ``Tokenizer.from_file(path)`` with
    ``add_special_tokens=False``, so the string of an added token in a text is that token.

    Where the file's ids follow its merges, tiktoken encodes by the same table, at several times the speed; any other
    file, a text with an added token's string, and any text that tiktoken refuses go to tokenizers itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], {t["content"] for t in spec.get("added_tokens", [])}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
    if not plain or any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return slow
    import public_tokenizers
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    # The alphabet writes printable bytes as themselves and the others, in order, from U+0100 on.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    assert set(byte) == set(ByteLevel.alphabet())
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    marked = re.compile("|".join(map(re.escape, sorted(added))) or r"(?!)").search
    table = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if marked(text):
            return slow(text)
        try:
            return table.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        except BaseException as e:  # tiktoken's own panics are no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, group_tokens: int = GROUP_TOKENS, encoder: Callable[[str], Callable[[str], np.ndarray]] = byte_bpe_encoder) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit integers, binary), doc_tokens, sequence_id, offset, padding.

    Every text (null counts as empty) becomes its ids and then id 1, so even an empty one has a token. Each id
    lies in exactly one piece. ``padding`` is what the piece's sequence lacks to the capacity. Repeated rows are
    packed each. Sequence ids are unique across tasks and hold the task's partition in their upper bits; an
    empty table gives an empty result; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 36
        ids, tokens, held, windows = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal windows
            rows = pack([len(t) for t in tokens], capacity, piece)
            load: dict[int, int] = {}
            for _, _, n, w, _ in rows:
                load[w] = load.get(w, 0) + n
            columns = [
                pa.array([ids[r[0]] for r in rows], type=id_arrow),
                *(pa.array([r[k] for r in rows], type=pa.int64()) for k in (1, 2)),
                pa.array([tokens[d][s : s + n].tobytes() for d, s, n, _, _ in rows], type=pa.binary()),
                pa.array([len(tokens[r[0]]) for r in rows], type=pa.int64()),
                pa.array([base + windows + r[3] for r in rows], type=pa.int64()),
                pa.array([r[4] for r in rows], type=pa.int64()),
                pa.array([capacity - load[r[3]] for r in rows], type=pa.int64()),
            ]
            windows += len(load)
            return pa.RecordBatch.from_arrays(columns, names=["__id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padding"])

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                tokens.append(np.append(encode(text.as_py()), np.array([END], dtype="<u4")))
                held += len(tokens[-1])
                if held >= group_tokens:
                    yield flush()
                    ids, tokens, held = [], [], 0
        if tokens:
            yield flush()

    narrow = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    out = narrow.mapInArrow(run, f"__id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padding long")
    return out.withColumnRenamed("__id", id_col)
