"""Quality rules: base statistics of each text, and robust multivariate outliers per language and source.

:func:`text_stats` counts over whole texts, vectorised over byte arrays.  :func:`mcd` estimates, for each
(lang, source), location and scatter of the transformed statistics by minimum covariance determinant:
two deterministic starts (median with MAD, mean with covariance) are improved by C-steps, each of which
keeps the fraction ``H`` of rows nearest by Mahalanobis distance; the start with the smaller determinant
wins.  A C-step is two aggregations over the statistics table (a mergeable quantile, then moments), so a
group of any size, also one with a third of all rows, is summed in every task before the shuffle.  Only
the k x k inversions run in Python, one row a group.

Estimates are broadcast while there are at most ``BROADCAST`` of them, of some 300 bytes each; beyond that rows of a hot group
are spread over tasks.

Cases: null text counts as empty; a text without words fails the base rules; a null language or source is
a group of its own; a group of fewer than ``MIN_ROWS`` rows that passed the base rules is judged by the
estimate of its language, or of all rows where the language has as few; the estimate of all rows takes any
number, its floors the wider the fewer there are; repeated rows count each; an empty table gives an empty
result; constant statistics are covered by the floors added to the variances.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leontia.llm.common import batch_of, chunks, coded, cut, ramp, spread_join, sums, word_spans

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 50, 50, 3
H, STEPS, MIN_ROWS, TAIL, BROADCAST = 0.75, 4, 40, 1e-9, 50_000
#: Least standard deviation of each feature, in its own units: below it, differences do not matter.
FEATURES = {"f_words": 0.25, "f_length": 0.05, "f_symbols": 0.35, "f_dup": 0.15, "f_repeat": 0.15}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")] + [("lang", pa.string()), ("source", pa.string())])
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, lang string, source string"


def count_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of the texts data[off[i] : off[i + 1]]."""
    rows = len(off) - 1
    start, end, n_words = word_spans(data, off)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[start] += 1
    in_word[end] -= 1
    in_word = np.cumsum(in_word[:-1]).astype(bool)
    out = {"n_words": n_words, "word_chars": sums(in_word & ((data & 0xC0) != 0x80), off), "n_symbols": sums(_SYMBOL[data], off)}

    cut_at = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    lo, hi = cut_at[:-1], cut_at[1:].copy()
    hi -= (data[np.maximum(hi - 1, 0)] == 10) & (hi > lo)
    words = np.searchsorted(start, hi) - np.searchsorted(start, lo)
    lo, hi = lo[words > 0], hi[words > 0]
    row = np.searchsorted(off, lo, "right") - 1
    code, distinct = coded(data, lo, hi)
    _, first = np.unique(row * (len(distinct) + 1) + code, return_index=True)
    out["n_lines"] = np.bincount(row, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[first], minlength=rows)

    windows = np.maximum(n_words - REPEAT_WIDTH + 1, 0)
    first_word = np.repeat(np.cumsum(n_words) - n_words, windows) + ramp(windows)
    code, distinct = coded(data, start, end)
    key = np.repeat(np.arange(rows), windows)  # numbers stay below windows * distinct words, far under 2^63
    for k in range(REPEAT_WIDTH):
        _, key, times = np.unique(key * (len(distinct) + 1) + code[first_word + k], return_inverse=True, return_counts=True)
    edge = np.zeros(len(start) + REPEAT_WIDTH + 1, np.int64)
    hit = first_word[times[key] >= 2] if len(key) else first_word
    edge[hit] += 1
    edge[hit + REPEAT_WIDTH] -= 1
    covered = np.cumsum(edge)[: len(start)] > 0
    out["n_repeat_words"] = sums(covered, np.concatenate([[0], np.cumsum(n_words)]))
    return out


def text_stats(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch):
                part = batch.slice(i, j - i)
                yield batch_of(_SCHEMA, doc_id=part.column("doc_id"), lang=part.column("lang").cast(pa.string()), source=part.column("source").cast(pa.string()), **count_stats(data, off))

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, _DDL)


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > 1e-17 * abs(total):
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(k / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(h: float, k: int) -> float:
    """What makes the covariance of the inner fraction h of a normal sample an estimate of the whole."""
    return h / _gamma_p(k / 2 + 1, chi2_quantile(h, k) / 2)


def features(stats: DataFrame) -> DataFrame:
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return stats.withColumns({
        "f_words": F.log1p(F.col("n_words").cast("double")),
        "f_length": F.log1p(F.col("word_chars") / n),
        "f_symbols": F.asinh(100.0 * F.col("n_symbols") / chars),
        "f_dup": F.sqrt(F.col("n_dup_lines") / lines),
        "f_repeat": F.sqrt(F.col("n_repeat_words") / n),
    })


_NAMES = list(FEATURES)
_K = len(_NAMES)
_PAIRS = [(i, j) for i in range(_K) for j in range(i, _K)]
_KEY = ["level", "lang", "source"]
#: Estimates from the narrowest to the widest; ``level`` is the index.
LEVELS = ("group", "lang", "all")
_PARAMS = "level int, lang string, source string, start int, n long, mu array<double>, prec array<double>, logdet double"


def _solve(moments: DataFrame, factor: float) -> DataFrame:
    """mu, inverse and log determinant of each group's covariance, floors added."""

    def run(frames):
        for f in frames:
            mu, prec, logdet = [], [], []
            for n, m, c in zip(f["n"], f["mu"], f["cov"]):
                s = np.zeros((_K, _K))
                for (i, j), v in zip(_PAIRS, c):
                    s[i, j] = s[j, i] = 0.0 if v is None or not math.isfinite(v) else v
                s = s * factor + max(1.0, MIN_ROWS / n) * np.diag([w * w for w in FEATURES.values()])
                mu.append(list(m)), prec.append(list(np.linalg.inv(s).ravel())), logdet.append(float(np.linalg.slogdet(s)[1]))
            yield pd.DataFrame({**{c: f[c] for c in (*_KEY, "start", "n")}, "mu": mu, "prec": prec, "logdet": logdet})

    return cut(moments.mapInPandas(run, _PARAMS))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(n) for n in _NAMES]
    return rows.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mu"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in _PAIRS]).alias("cov"))


def distance2() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's mu and prec."""
    d = [F.col(n) - F.col("mu")[i] for i, n in enumerate(_NAMES)]
    return sum((F.col("prec")[i * _K + j] * d[i] * d[j] * (1.0 if i == j else 2.0) for i, j in _PAIRS), F.lit(0.0))


def _at_levels(rows: DataFrame) -> DataFrame:
    """The features of the rows of each estimate: every row in its group, its language and the whole."""
    at = [F.struct(F.lit(i).alias("level"), lang.alias("lang"), source.alias("source")) for i, (lang, source) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), F.lit("")), (F.lit(""), F.lit(""))])]
    return rows.select(F.explode(F.array(*at)).alias("at"), *_NAMES).select("at.*", *_NAMES)


def _by_key(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a written table of some rows a group."""
    return rows.join(F.broadcast(few), keys, how) if few.count() <= BROADCAST else spread_join(rows, few, *keys, how=how)


def mcd(rows: DataFrame) -> DataFrame:
    """(level, lang, source, mu, prec) of all rows and of each group or language of at least MIN_ROWS; nulls in keys must be gone."""
    x, key, rows = [F.col(n) for n in _NAMES], _KEY, _at_levels(rows)
    middle = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(x)]).where((F.col("n") >= MIN_ROWS) | (F.col("level") == len(LEVELS) - 1)))
    spread = _by_key(rows, middle, key).groupBy(*key).agg(
        F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(_K)], *[F.percentile_approx(F.abs(c - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, c in enumerate(x)], F.array(*[F.avg(c) for c in x]).alias("mu"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in _PAIRS]).alias("cov")
    )
    robust = spread.select(*key, "n", F.lit(0).alias("start"), F.array(*[F.col(f"m{i}").cast("double") for i in range(_K)]).alias("mu"), F.array(*[F.pow(1.4826 * F.col(f"s{i}"), F.lit(2.0)) if i == j else F.lit(0.0) for i, j in _PAIRS]).alias("cov"))
    spread = cut(robust.unionByName(spread.select(*key, "n", F.lit(1).alias("start"), "mu", "cov")))
    params, factor = _solve(spread, 1.0), consistency(H, _K)
    for _ in range(STEPS):
        scored = _by_key(rows, params, key).withColumn("d2", distance2())
        bound = cut(scored.groupBy(*key, "start").agg(F.percentile_approx("d2", H, 10000).alias("bound")))
        inner = _by_key(scored, bound, [*key, "start"]).where(F.col("d2") <= F.col("bound"))
        params = _solve(_moments(inner, [*key, "start"]), factor)
    best = params.groupBy(*key).agg(F.min(F.struct("logdet", "start", "mu", "prec")).alias("b"))
    return cut(best.select(*key, "b.mu", "b.prec"))


def estimates(groups: DataFrame, params: DataFrame) -> DataFrame:
    """(lang, source, level, mu, prec): the narrowest estimate there is for each group."""
    at = [params.where(F.col("level") == i).select(F.col("lang").alias(f"lang{i}"), F.col("source").alias(f"source{i}"), F.struct("level", "mu", "prec").alias(f"e{i}")) for i in range(len(LEVELS))]
    groups = groups.join(at[0], (F.col("lang") == F.col("lang0")) & (F.col("source") == F.col("source0")), "left")
    groups = groups.join(at[1], F.col("lang") == F.col("lang1"), "left").join(F.broadcast(at[2]), F.lit(True), "left")
    return groups.select("lang", "source", F.coalesce("e0", "e1", "e2").alias("e")).select("lang", "source", "e.*")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row a document: base statistics, base_failed, kept, the squared distance within its group, and the estimate it was judged by with the squared distance there.

    ``distance2`` is null where the group has no estimate of its own; ``judged_distance2`` is what ``kept`` comes from.
    """
    stats = cut(features(text_stats(docs)).withColumns({c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), c)) for c in ("lang", "source")}))  # null is no text
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    params = cut(estimates(stats.select("lang", "source").distinct(), mcd(stats.where(~failed))))
    far = F.coalesce(F.col("d2") > F.lit(chi2_quantile(1 - TAIL, _K)), F.lit(False))
    judged = F.round("d2", 6)
    return (
        _by_key(stats, params, ["lang", "source"], "left")
        .withColumn("d2", distance2())
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.when(F.col("level") == 0, judged).alias("distance2"),
            F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1).alias("judged_by"), judged.alias("judged_distance2"),
        )
    )
