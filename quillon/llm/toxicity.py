"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and their beginnings is trained from confirmed toxic documents (positives) and unlabelled text.
The risk is that of Kiryo and others: pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]) with the logistic loss and the
class prior pi; where the corrected negative part falls below zero, its gradient is followed upwards instead.

Training reads bounded samples (``positives`` and ``unlabelled`` rows, by hash order of the id) and runs in numpy on the
driver; scoring reads whole texts where they lie and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, sample_ids, slices, text_of
from quillon.llm.simhash import components

POSITIVES = 4000
UNLABELLED = 12_000
#: Features for each positive of the sample: so many words, those whose shares among positives and unlabelled rows differ most clearly, enter the
#: classifier; at every size of the sample there are some, and fewer than there are positives to weigh them.
PER_POSITIVE = 0.3
#: Beginnings of words are features as well, so that inflected and compounded forms meet.
PREFIXES = (5, 6, 7)
_words = re.compile(r"[^\W\d_]+").findall


def features(text: str | None) -> set[str]:
    """Lower-case words of letters, and the beginnings of longer ones, marked by a star."""
    words = set(_words((text or "").lower()))
    return words.union(*({f"{w[:k]}*" for w in words if len(w) > k} for k in PREFIXES))


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        w = self.weights
        g = self.bias + sum(w[x] for x in w.keys() & features(text))
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def fit_nnpu(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 800, rate: float = 0.05, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear score over binary features, given as (row, column) pairs; ``positive`` marks rows."""
    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    n_p, n_u = positive.sum(), (~positive).sum()
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    order = np.argsort(rows, kind="stable")
    rows, columns = rows[order], columns[order]
    for t in range(1, steps + 1):
        g = np.bincount(rows, weights=w[columns], minlength=len(positive)) + b
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        # l(g) = log(1 + exp(-g)): its slope is s - 1; that of l(-g) is s.
        soft = np.logaddexp(0, g)
        negative = soft[~positive].mean() - prior * soft[positive].mean()
        slope_n = np.where(positive, -prior * s / n_p, s / n_u)
        slope = np.where(positive, prior * (s - 1) / n_p, 0.0) + slope_n if negative >= 0 else -slope_n
        grad = np.append(np.bincount(columns, weights=slope[rows], minlength=n_features) + l2 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicModel:
    """Labels are read only where ``allowed`` holds of their id; unlabelled text comes from such rows too.

    Null texts count as empty, null labels as none; repeated rows and near copies count once. Without positives, or without text to set
    them against, every score is zero. ``positives`` and ``unlabelled`` bound what is learned from, and with them the model.
    """
    known = labels.filter(allowed & F.col(label_col).isNotNull())
    share = known.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    if not share:
        return ToxicModel({}, -30.0, 0.0)
    prior = min(0.5, share)
    p = sample_ids(known.filter(F.col(label_col) == 1), id_col, positives).withColumn("__p", F.lit(True))
    u = sample_ids(docs.filter(allowed), id_col, unlabelled).withColumn("__p", F.lit(False))
    chosen = F.broadcast(p.union(u))  # at most positives + unlabelled ids
    sample = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(chosen, "__id").select("__id", "__p", "__text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 2, 512)):
            found = [sorted(features(t)) for t in part.column(2).to_pylist()]
            keys = [_bands(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.list_(pa.string())), *(pa.array([k[b] for k in keys], pa.int64()) for b in range(BANDS))],
                names=["key", "p", "words", *(f"b{b}" for b in range(BANDS))],
            )

    keyed = sample.select(F.concat_ws(":", F.col("__id").cast("string"), F.col("__p").cast("string")).alias("key"), F.col("__p").alias("p"), "__text")
    bagged = keyed.mapInArrow(bags, "key string, p boolean, words array<string>, " + ", ".join(f"b{b} long" for b in range(BANDS)))
    bagged = cut(bagged.withColumn("row", F.monotonically_increasing_id()))
    # Copies would count their chance words as often as they occur: of rows joined by chains of equal bands, the first one stays.
    edges = None
    for b in range(BANDS):
        first = bagged.groupBy("p", f"b{b}").agg(F.min("row").alias("a"))
        new = bagged.join(first, ["p", f"b{b}"]).filter("row <> a").select("a", F.col("row").alias("b"))
        edges = new if edges is None else edges.union(new)
    copies = components(edges).filter("node <> root").select(F.col("node").alias("row"))
    kept = cut(bagged.join(F.broadcast(copies), "row", "left_anti").select("key", "p", "words"))  # fewer than the sample's rows
    sizes = {r["p"]: r["count"] for r in kept.groupBy("p").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return ToxicModel({}, -30.0, prior)
    counted = kept.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.col("p").cast("long")).alias("in_p"), F.count(F.lit(1)).alias("n"))
    ranked = counted.filter("in_p > 0").orderBy(_contrast(F.col("in_p"), F.col("n") - F.col("in_p"), n_p, n_u).desc(), "word")
    telling = sorted(r["word"] for r in ranked.limit(max(1, int(PER_POSITIVE * n_p))).collect())
    if not telling:  # no positive has a word
        return ToxicModel({}, -30.0, prior)
    place = {w: i for i, w in enumerate(telling)}
    table = kept.select("key", "p", F.array_intersect("words", F.lit(telling)).alias("words")).toPandas().sort_values("key", ignore_index=True)
    rows = np.repeat(np.arange(len(table)), table["words"].map(len))
    columns = np.array([place[w] for ws in table["words"] for w in ws], dtype=np.int64)
    w, bias = fit_nnpu(rows, columns, table["p"].to_numpy(bool), len(telling), prior)
    return ToxicModel(dict(zip(telling, map(float, w), strict=True)), bias, prior)


#: Bags are taken for near copies if one of the bands of so many MinHash values agrees.
BANDS, DEPTH = 3, 4
_FACTORS = np.random.default_rng(5).integers(1, 1 << 32, (BANDS * DEPTH, 2), dtype=np.uint64) | np.uint64(1)


def _bands(bag: list[str]) -> list[int]:
    h = np.array([zlib.crc32(w.encode()) for w in bag] or [0], dtype=np.uint64)
    least = [int(((h * a + b) & np.uint64(0xFFFFFFFF)).min()) for a, b in _FACTORS]
    return [hash(tuple(least[b * DEPTH : (b + 1) * DEPTH])) for b in range(BANDS)]


def _contrast(in_p: Column, in_u: Column, n_p: int, n_u: int) -> Column:
    """Standard score of the difference between a word's document shares among positives and unlabelled rows."""
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    return (in_p / n_p - in_u / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))


def toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted (1 from 0.5 on).

    Null text counts as empty and gets the score of a text without known words. Equal texts get equal results; an
    empty table an empty one; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["__id", "score", "predicted"])

    narrow = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    return narrow.mapInArrow(run, f"__id {id_type}, score double, predicted int").withColumnRenamed("__id", id_col)
