"""Language identification by interpolated Kneser-Ney character models, one per language.

A word is padded with marks and predicted character by character from up to three characters before, so a text's
log-probability is a sum over its words: a task scores each distinct word once. Keys of all languages' n-grams lie
in sorted arrays of 64-bit numbers (16 bits a character), one array per order, found by binary search. The language of
lowest cross-entropy per character wins; a temperature fitted on a calibration fold turns the margins into a probability
and per-language quantiles of that fold mark texts that fit no learned language.

Training reads a bounded sample (``per_lang`` documents a language, by hash order of the id); scoring reads whole texts
and shuffles nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, sample_ids, text_of

ORDER = 4
PER_LANG = 1500
UNDETERMINED = "und"
#: Words whose scores a task remembers; past that it forgets all. Only speed depends on it.
MEMORY = 300_000
_LETTER = re.compile(r"[^\W\d_]")
_START, _END = 2, 3
_FLOOR = 1 / 65536


def _codes(word: str) -> list[int]:
    """16-bit codes of a lower-case word between its marks; characters past U+FFFF share the upper codes by remainder."""
    return [_START, *(c if c < 65536 else 57344 + c % 6400 for c in map(ord, word)), _END]


def kneser_ney(words: dict[str, int], order: int = ORDER) -> list[dict[int, tuple[float, float]]]:
    """For each order, n-gram key -> (log-probability, log of the weight that it passes to the next lower order as a context).

    Counts of the highest order, and of n-grams at a word's start, are plain; others count the distinct characters before.
    """
    counts: list[Counter] = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        codes = _codes(word)
        for i in range(1, len(codes)):
            key = codes[i]
            for k in range(1, min(order, i + 1) + 1):
                if k > 1:
                    key |= codes[i - k + 1] << (16 * (k - 1))
                if k == order or k == i + 1:
                    counts[k][key] += n
    for k in range(order - 1, 0, -1):
        mask = (1 << (16 * k)) - 1
        for key in counts[k + 1]:
            counts[k][key & mask] += 1
    out: list[dict[int, tuple[float, float]]] = [{} for _ in range(order + 1)]
    probability: list[dict[int, float]] = [{} for _ in range(order + 1)]
    weight: list[dict[int, float]] = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        once = sum(1 for c in counts[k].values() if c == 1)
        twice = sum(1 for c in counts[k].values() if c == 2)
        discount = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))
        total: dict[int, int] = defaultdict(int)
        kinds: dict[int, int] = defaultdict(int)
        for key, c in counts[k].items():
            total[key >> 16] += c
            kinds[key >> 16] += 1
        # The context of key is what stands before its last character.
        for key, c in counts[k].items():
            context = key >> 16
            passed = discount * kinds[context] / total[context]
            weight[k - 1][context] = passed
            lower = _FLOOR if k == 1 else probability[k - 1].get(key & ((1 << (16 * (k - 1))) - 1), _FLOOR)
            probability[k][key] = max(c - discount, 0) / total[context] + passed * lower
    for k in range(1, order + 1):
        for key in probability[k].keys() | weight[k].keys():
            out[k][key] = (math.log(probability[k][key]) if key in probability[k] else math.nan, math.log(weight[k].get(key, 1.0)))
    out[0][0] = (math.log(_FLOOR), math.log(weight[0].get(0, 1.0)))
    return out


@dataclass
class LanguageModel:
    """keys[k]: sorted n-grams of order k; logp[k], pass_on[k]: rows of them, a column a language (NaN: not seen)."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    pass_on: list[np.ndarray]
    temperature: float = 1.0
    worst: np.ndarray | None = None

    @classmethod
    def of(cls, models: dict[str, list[dict[int, tuple[float, float]]]]) -> LanguageModel:
        languages = sorted(models)
        keys, logp, pass_on = [], [], []
        for k in range(ORDER + 1):
            ks = np.array(sorted(set().union(*(models[x][k] for x in languages))), dtype=np.uint64)
            p, w = np.full((len(ks), len(languages)), np.nan, np.float32), np.zeros((len(ks), len(languages)), np.float32)
            for j, x in enumerate(languages):
                own = models[x][k]
                at = np.searchsorted(ks, np.fromiter(own, np.uint64, len(own)))
                values = np.array(list(own.values()), dtype=np.float32).reshape(-1, 2)
                p[at, j], w[at, j] = values[:, 0], values[:, 1]
            keys.append(ks)
            logp.append(p)
            pass_on.append(w)
        return cls(languages, keys, logp, pass_on)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Natural log-probabilities, a row a word and a column a language."""
        codes = [_codes(w) for w in words]
        lengths = np.array([len(c) for c in codes])
        flat = np.fromiter((x for c in codes for x in c), np.uint64, lengths.sum())
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(flat)) - np.repeat(starts, lengths)
        out = np.repeat(self.logp[0][:1], len(flat), axis=0)
        key, before, seen_before = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.int64), np.ones(len(flat), bool)
        for k in range(1, ORDER + 1):
            key = key.copy()
            key[k - 1 :] |= flat[: len(flat) - k + 1] << np.uint64(16 * (k - 1))
            valid = place >= max(k - 1, 1)
            at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            seen = valid & (self.keys[k][at] == key)
            # Where the longer n-gram is unknown, its context passes on to the shorter one.
            passed = np.where((seen_before & valid)[:, None], self.pass_on[k - 1][before], np.float32(0))
            mine = np.where(seen[:, None], self.logp[k][at], np.float32(np.nan))
            out = np.where(np.isnan(mine), out + passed, mine)
            # As a context an n-gram ends one place earlier; marks at a word's start count as contexts too.
            known = (place >= k - 1) & (self.keys[k][at] == key)
            before, seen_before = np.roll(at, 1), np.roll(known, 1)
            before[:1], seen_before[:1] = 0, False
        out[place == 0] = 0
        return np.add.reduceat(out, starts, axis=0) if len(words) else np.zeros((0, len(self.languages)), np.float32)


class Scorer:
    def __init__(self, model: LanguageModel) -> None:
        self.model, self.index, self.rows = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log-probability per predicted character, a column a language, and the number of characters."""
        split = [t.lower().split() for t in texts]
        if len(self.index) > MEMORY:
            self.index, self.rows = {}, self.rows[:0]
        index = self.index
        new = sorted({w for ws in split for w in ws if w not in index})
        added = [self.rows]
        for i in range(0, len(new), 20_000):
            added.append(self.model.score_words(new[i : i + 20_000]))
        for w in new:
            index[w] = len(index)
        self.rows = np.concatenate(added)
        out, chars = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        for i, ws in enumerate(split):
            if ws:
                chars[i] = sum(map(len, ws)) + len(ws)
                out[i] = -self.rows[np.array([index[w] for w in ws])].sum(axis=0, dtype=np.float64) / chars[i]
        return out, chars

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        model = self.model
        texts = ["" if t is None else t for t in texts]
        if not model.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        ce, chars = self.entropies(texts)
        p = posterior(ce, chars, model.temperature)
        best = ce.argmin(axis=1)
        none = np.array([_LETTER.search(t) is None for t in texts], dtype=bool)
        score = np.where(none, 0.0, p[np.arange(len(texts)), best]) if texts else np.zeros(0)
        limit = np.full(len(model.languages), np.inf) if model.worst is None else model.worst
        rejected = none | (ce[np.arange(len(texts)), best] > limit[best])
        return [UNDETERMINED if n else model.languages[b] for n, b in zip(none, best, strict=True)], np.clip(score, 0, 1), rejected


def posterior(ce: np.ndarray, chars: np.ndarray, temperature: float) -> np.ndarray:
    """Softmax of the cross-entropy margins; longer texts count by the root of their length."""
    z = -(ce - ce.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(chars, 1))[:, None] * temperature
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> LanguageModel:
    """Models and calibration from ``per_lang`` rows a language among those where ``allowed`` holds.

    A fifth of the sample calibrates. Words are counted by Spark; a task a language turns counts into n-grams.
    """
    key = F.xxhash64(id_col)
    usable = allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    ids = F.broadcast(sample_ids(docs.filter(usable), id_col, per_lang, lang_col).distinct())  # at most per_lang ids a language
    sample = docs.filter(usable).join(ids, docs[id_col].eqNullSafe(ids["__id"]), "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.pmod(key, F.lit(5)) == 0).alias("calibrate"))
    words = sample.filter(~F.col("calibrate")).select("lang", F.explode(F.split(F.lower("text"), f"{SPACE}+")).alias("word")).filter("word <> ''").groupBy("lang", "word").count()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = kneser_ney(dict(zip(pdf["word"], pdf["count"], strict=True)))
        arrays = [(k, np.fromiter(m, np.uint64, len(m)).tobytes(), np.array(list(m.values()), np.float64).tobytes()) for k, m in enumerate(rows)]
        return pd.DataFrame([(pdf["lang"].iloc[0], *a) for a in arrays], columns=["lang", "k", "keys", "pairs"])

    models: dict[str, list[dict[int, tuple[float, float]]]] = {}
    for r in words.groupBy("lang").applyInPandas(fit, "lang string, k int, keys binary, pairs binary").collect():
        pairs = np.frombuffer(r["pairs"]).reshape(-1, 2)
        models.setdefault(r["lang"], [{} for _ in range(ORDER + 1)])[r["k"]] = dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), map(tuple, pairs.tolist()), strict=True))
    model = LanguageModel.of(models)
    if not models:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            ce, chars = scorer.entropies(b["text"].tolist())
            yield pd.DataFrame({"lang": b["lang"], "ce": list(ce), "chars": chars})

    seen = sample.filter("calibrate").mapInPandas(measure, "lang string, ce array<double>, chars double").toPandas()
    seen = seen[(seen["chars"] > 0) & seen["lang"].isin(model.languages)]
    if len(seen):
        ce, chars = np.array(seen["ce"].tolist()), seen["chars"].to_numpy()
        truth = np.array([model.languages.index(x) for x in seen["lang"]])
        loss = {t: -np.log(np.maximum(posterior(ce, chars, t)[np.arange(len(truth)), truth], 1e-9)).mean() for t in np.geomspace(0.05, 20, 25)}
        model.temperature = float(min(loss, key=loss.__getitem__))
        right = ce.argmin(axis=1) == truth
        model.worst = np.array([1.1 * np.quantile(ce[right & (truth == j), j], 0.995) if (right & (truth == j)).any() else np.inf for j in range(len(model.languages))])
    return model


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, rejected.

    ``und`` (score 0) for null text and texts without a letter, and for all texts if no language was learned. ``rejected``
    marks these and texts that fit their language worse than 99.5 % of the calibration fold, by a tenth. Equal texts get
    equal results; an empty table an empty one; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pred, score, rejected = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["__id", "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    return narrow.mapInArrow(run, f"__id {id_type}, lang_pred string, score double, rejected boolean").withColumnRenamed("__id", id_col)
