"""Quality rules by weak supervision: each rule votes good, bad or abstains; EM weighs the votes.

Native: DataFrame functions only. Features and votes are array expressions over one row, so no text is
shuffled. The corpus reaches the model as counts of vote patterns: with R rules there are at most 3^R of
them at any corpus size, and a plain loop over those counts runs expectation-maximisation on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, cut, text_of

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = "the of and to in is that it for on was be with as by this are from or at le la de et les des un une du en que qui dans pour sur pas der die das und den von zu mit ist im nicht ein eine el los las y se del por con para su".split()

#: A measure by its name, as a column.
Measures = Callable[[str], Column]

#: name: (ratio, good bound, bad bound). A ratio up to the good bound votes good, one above the bad bound votes bad, any
#: other abstains. Rules without a good bound only look for a defect.
RULES: dict[str, tuple[Callable[[Measures], Column], float | None, float]] = {
    "symbols": (lambda m: m("n_symbols") / m("n_words"), 0.05, 0.10),
    "few_function_words": (lambda m: 1 - m("n_function_words") / m("n_words"), 0.90, 0.92),
    "repeats": (lambda m: m("n_repeat_words") / m("n_words"), None, 0.20),
    "dup_lines": (lambda m: m("n_dup_lines") / F.greatest(m("n_lines"), F.lit(1)), None, 0.30),
    "shouting": (lambda m: m("n_capitals") / F.greatest(m("word_chars"), F.lit(1)), None, 0.40),
    "word_length": (lambda m: F.abs(m("word_chars") / m("n_words") - 6.0), None, 4.0),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once a row: a lambda variable stays one value where the optimizer would inline a column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_starts(words: Column) -> Column:
    """Sorted starts of the three-word windows that occur at least twice among ``words``.

    Windows meet through their 64-bit hashes, sorted within the row; neighbours of one hash are compared word by word.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )),
    ).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:int>>"))

    def same(a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for k in range(3):
            equal = equal & (F.get(words, a["i"] + k) == F.get(words, b["i"] + k))
        return equal

    def pairs(ws: Column) -> Column:
        n = F.greatest(F.size(ws) - 1, F.lit(0))
        return F.zip_with(F.slice(ws, 1, n), F.slice(ws, 2, n), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])))

    return F.sort_array(F.array_distinct(F.flatten(F.filter(_let(windows, pairs), lambda x: x.isNotNull()))))


def _covered(starts: Column) -> Column:
    """Number of words in the union of the three-word windows at ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct((s + 3).alias("end"), (a["n"] + (s + 3 - F.greatest(s, a["end"]))).cast("long").alias("n")),
        lambda a: a["n"],
    )



def measures(text: Column) -> Column:
    """A struct of the measures the rules read, of one text.

    A word is a run outside ``[\\x20\\x09-\\x0D]``. ``n_repeat_words`` counts the words that lie in a window of
    three words found at least twice in the text.
    """

    def of(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        words = F.array_remove(F.split(text, f"{SPACE}+"), "")
        by_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        by_word = _let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("function"),
            _covered(_repeated_starts(w)).alias("repeat"),
        ))
        counted = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
        return _let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda x: F.struct(
            x["w"]["n"].alias("n_words"),
            x["w"]["chars"].alias("word_chars"),
            counted(r"[#*$%&|<>]").alias("n_symbols"),
            counted("!").alias("n_shouts"),
            counted(r"\p{Lu}").alias("n_capitals"),
            x["l"]["n"].alias("n_lines"),
            x["l"]["dup"].alias("n_dup_lines"),
            x["w"]["function"].alias("n_function_words"),
            x["w"]["repeat"].alias("n_repeat_words"),
        ))

    return _let(text, of)


def base_failed(m: Measures) -> Column:
    return (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))


def votes(m: Measures, rules: dict | None = None) -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains; a text without words gets abstentions alone."""
    out = {}
    for name, (ratio, good, bad) in (RULES if rules is None else rules).items():
        out[name] = F.when(m("n_words") == 0, 0).when(ratio(m) > bad, -1).otherwise(0 if good is None else F.when(ratio(m) <= good, 1).otherwise(0))
    return out


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good texts. right_good, right_bad: chance that a rule that votes is right, on good and on bad texts."""

    names: tuple[str, ...]
    prior: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def posterior(self, votes_by_name: dict[str, Column]) -> Column:
        logit: Column = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, g, b in zip(self.names, self.right_good, self.right_bad, strict=True):
            logit = logit + F.when(votes_by_name[name] == 1, math.log(g / (1 - b))).when(votes_by_name[name] == -1, math.log((1 - g) / b)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], names: tuple[str, ...], prior: float = 0.8, right: float = 0.8, steps: int = 50) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    Accuracies stay within 0.5 and 0.99 and carry a Beta(8, 2)-like prior count, so that rules that seldom vote
    keep a sensible weight and the two classes cannot change places. No patterns: the starting values.
    """
    pi, good, bad = prior, [right] * len(names), [right] * len(names)
    clip = lambda x, lo, hi: min(hi, max(lo, x))
    for _ in range(steps if patterns else 0):
        total = n_good = 0.0
        hit_g, all_g, hit_b, all_b = ([0.0] * len(names) for _ in range(4))
        for pattern, count in patterns:
            logit = math.log(pi / (1 - pi))
            for v, g, b in zip(pattern, good, bad, strict=True):
                logit += math.log(g / (1 - b)) if v == 1 else math.log((1 - g) / b) if v == -1 else 0.0
            q = 1 / (1 + math.exp(-logit))
            total, n_good = total + count, n_good + count * q
            for r, v in enumerate(pattern):
                if v:
                    all_g[r] += count * q
                    all_b[r] += count * (1 - q)
                    hit_g[r] += count * q * (v == 1)
                    hit_b[r] += count * (1 - q) * (v == -1)
        pi = clip((n_good + 8) / (total + 10), 0.02, 0.98)
        good = [clip((h + 8) / (a + 10), 0.5, 0.99) for h, a in zip(hit_g, all_g, strict=True)]
        bad = [clip((h + 8) / (a + 10), 0.5, 0.99) for h, a in zip(hit_b, all_b, strict=True)]
    return VoteModel(names, pi, tuple(good), tuple(bad))


def vote_model(patterns: DataFrame) -> VoteModel:
    """Fit on all rows that the base rules leave, given as a struct column ``v`` of ``base_failed`` and the votes: at most 2 * 3^R
    counted patterns come to the driver."""
    names = tuple(RULES)
    counted = [(r["v"], r["count"]) for r in patterns.groupBy("v").count().collect()]
    return fit_votes(sorted((tuple(v[n] for n in names), c) for v, c in counted if not v["base_failed"]), names)


def _pattern(m: Measures) -> Column:
    return F.struct(base_failed(m).alias("base_failed"), *[c.alias(n) for n, c in votes(m).items()])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, the measures, base_failed, kept, p_good.

    Null text counts as empty: no words, base_failed true. Measures of one pass are checkpointed as narrow rows
    and serve both the fit and the verdicts. Repeated rows get equal verdicts; an empty table an empty result;
    other columns are not read.
    """
    measured = cut(docs.select(F.col(id_col).alias("__id"), measures(text_of(text_col)).alias("__m")))
    m = lambda name: F.col(f"__m.{name}")
    good = vote_model(measured.select(_pattern(m).alias("v"))).posterior(votes(m))
    out = measured.withColumns({"base_failed": base_failed(m), "p_good": good})
    return out.select(
        F.col("__id").alias(id_col),
        *[m(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"),
        "p_good",
    )


def keep_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. A verdict depends on the text and the fitted model alone.

    Texts are measured twice, for the fit and for the verdict, rather than shuffled; each time once a row.
    """
    of = lambda body: _let(measures(text_of(text_col)), lambda s: body(lambda name: s[name]))
    model = vote_model(docs.select(of(_pattern).alias("v")))
    return docs.filter(of(lambda m: ~base_failed(m) & (model.posterior(votes(m)) >= threshold)))
