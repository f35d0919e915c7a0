"""Runs of words that repeat with a period, by heavy/light lag counting.

A run is a stretch of words, as long as it can be, whose smallest period goes into it at least four times. At lag q it shows as at
least max(6, 4q) - q places in a row whose word equals the one q further on. So matches are counted for every lag up to a quarter of
the text first, all of them and exactly: words that are frequent in a text by autocorrelation of their places (an FFT whose sums are whole
numbers far below the precision), the others by the differences of their places, for all texts of a slice at once. What is frequent follows
from the text's length alone, so that neither way costs more than about n ** 1.5. Only lags with enough matches get a scan for islands of matches.

Lags are taken upwards. A run of period p shows again at each multiple of p, as one whole island: its matches are taken off there, so that
a text of one word costs one scan. A scan looks at every (q/8)th place first, since an island of 3q matches covers 24 of these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, slices

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Texts of a slice; their places are held together.
TEXTS = 256

_WORD = re.compile(WORD)
Run = tuple[int, int, int]  # start, length, period


def enough(lag: np.ndarray | int) -> np.ndarray | int:
    """Matches in a row at a lag that make a run."""
    return np.maximum(LEAST_WORDS, LEAST_TIMES * lag) - lag


def heavy_from(n: int) -> int:
    """Occurrences from which a word of a text of n words is frequent: where pairs of places cost about as much as a transform."""
    return int(np.sqrt(n * np.log2(n + 2))) + 8


def lag_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, given as numbers of its words from 0: how many places i have the same word at i + q, for q from 0 (unused) to n // 4."""
    most = [len(t) // LEAST_TIMES for t in texts]
    first = np.concatenate([[0], np.cumsum(np.array(most, np.int64) + 1)])
    counts = np.zeros(first[-1], np.int64)
    keys, places, spans, bases = [], [], [], []
    named = 0
    for t, words in enumerate(texts):
        if not most[t]:
            continue
        often = np.bincount(words)
        heavy = np.flatnonzero(often >= heavy_from(len(words)))
        if len(heavy):
            size = 1 << int(len(words) + most[t]).bit_length()
            for w in heavy.tolist():
                power = np.abs(np.fft.rfft(words == w, size)) ** 2
                counts[first[t] : first[t + 1]] += np.rint(np.fft.irfft(power, size)[: most[t] + 1]).astype(np.int64)
        light = (often > 1) & (often < heavy_from(len(words)))
        at = np.flatnonzero(light[words])
        keys.append(words[at] + named)
        places.append(at)
        spans.append(np.full(len(at), most[t]))
        bases.append(np.full(len(at), first[t]))
        named += len(often)
    if keys:
        key, place, span, base = map(np.concatenate, (keys, places, spans, bases))
        order = np.argsort(key, kind="stable")
        key, place, span, base = key[order], place[order], span[order], base[order]
        here, ahead = np.arange(len(key)), 1
        while len(here := here[here + ahead < len(key)]):
            lag = place[here + ahead] - place[here]
            # The differences of a place grow with how far ahead is looked: one that is too large, or of another word, is its last.
            near = (key[here + ahead] == key[here]) & (lag <= span[here])
            here, lag = here[near], lag[near]
            np.add.at(counts, base[here] + lag, 1)
            ahead += 1
    return [counts[first[t] : first[t + 1]] for t in range(len(texts))]


def islands(words: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """(start, length) of the longest stretches of places whose word equals the one ``lag`` further on, of those that make a run."""
    n, need, step = len(words) - lag, int(enough(lag)), max(1, lag // 8)
    rough = _stretches(words[:n:step] == words[lag::step], need // step)
    if step == 1:
        return rough
    out = []
    for start, length in rough:
        begin, end = max(0, (start - 1) * step + 1), min(n, (start + length) * step)
        out += [(begin + s, m) for s, m in _stretches(words[begin:end] == words[begin + lag : end + lag], need)]
    return out


def _stretches(same: np.ndarray, need: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= need
    return list(zip(starts[long].tolist(), (ends - starts)[long].tolist(), strict=True))


def runs(words: np.ndarray, counts: np.ndarray) -> list[Run]:
    """All runs of a text by start, then period, from its words' numbers and its counts of each lag."""
    found: dict[tuple[int, int], int] = {}
    left = counts.copy()
    lags = np.arange(len(left))
    left[0] = 0
    for lag in np.flatnonzero(left >= enough(lags)).tolist():
        if lag == 0 or left[lag] < enough(lag):
            continue
        for start, matches in islands(words, lag):
            whole = (start, matches + lag)
            if whole not in found:
                found[whole] = lag
                again = lags[2 * lag :: lag]
                left[2 * lag :: lag] -= np.maximum(whole[1] - again, 0)
    return sorted((start, length, period) for (start, length), period in found.items())


def numbered(words: list[str]) -> np.ndarray:
    numbers: dict[str, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def collapsed(words: list[str], found: list[Run]) -> str:
    """The words, joined by a space, without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return " ".join([w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g])


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: the runs of its words as (start, length, period) by start, then period, and the text without
    repetitions, its words joined by one space.

    Null and empty texts, and those of white space alone, have no words, no runs and the empty text. A run of fewer than six words is none. Whole
    texts are taken, whatever their length; one text is the least a task holds. Repeated rows are each answered; ids may be null. Other columns are neither
    read nor returned. An empty table gives an empty result. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, TEXTS, 4_000_000):
                texts = [_WORD.findall(t or "") for t in some.column(1).to_pylist()]
                numbers = [numbered(t) for t in texts]
                found = [runs(n, c) if len(c) > 1 else [] for n, c in zip(numbers, lag_counts(numbers), strict=True)]
                out = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(out, _RUNS), pa.array([collapsed(t, r) for t, r in zip(texts, found, strict=True)], pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = narrow.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
