"""Document quality by a regularised quadratic discriminant.

A document is a vector of transformed statistics of its text (logarithms and
log-ratios, which are closer to normal than counts).  Means and covariances of
both classes come from one aggregation of sums and products over the labelled
rows.  Each class covariance is shrunk towards the pooled one and towards a
multiple of the identity; its Cholesky factor is inverted once, on the driver
(it is as large as the number of features), and a score is the log-density
difference of both classes: Mahalanobis distances by triangular forms that are
plain column arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.llm import textstats

#: Weights of the pooled covariance and of the identity in a class covariance.
POOLED, RIDGE = 0.2, 0.02
FEATURES = ("f_words", "f_word_length", "f_symbols", "f_bangs", "f_upper", "f_digits", "f_distinct", "f_line_words", "f_ends", "f_repeats")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Key, ``more`` columns and ``FEATURES`` of each document; a null text counts as an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key), *more, t.alias("__t"), textstats.words(t).alias("__w"))
    n = F.size("__w")
    chars = F.length("__t")
    odds = lambda part, whole: F.log((part + F.lit(0.5)) / (whole - part + F.lit(0.5)))
    sentence = F.octet_length(F.regexp_replace("__t", "[.!?]+", "")) - F.octet_length("__t")
    values = (
        F.log1p(n),
        F.log1p(F.octet_length(F.array_join("__w", "")) / F.greatest(n, F.lit(1))),
        odds(textstats.count_chars(F.col("__t"), textstats.SYMBOLS), chars),
        odds(textstats.count_chars(F.col("__t"), "!"), chars),
        odds(F.regexp_count("__t", F.lit("[A-Z]")), chars),
        odds(F.regexp_count("__t", F.lit("[0-9]")), chars),
        odds(F.size(F.array_distinct("__w")), n),
        F.log1p(n / (textstats.count_chars(F.col("__t"), "\n") + 1)),
        odds(F.least(-sentence, n), n),
        odds(F.size(F.filter(F.zip_with("__w", F.slice("__w", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))), n),
    )
    return own.select(key, *more, *(v.cast("double").alias(name) for name, v in zip(FEATURES, values, strict=True)))


@dataclass(frozen=True)
class Model:
    """Standardisation, and of each class mean, inverse Cholesky factor and constant; ``only``: the score where a class is missing."""

    centre: list[float]
    scale: list[float]
    means: list[list[float]]
    factors: list[list[list[float]]]
    constants: list[float]
    only: float | None = None


def learn(rows: DataFrame, label: str) -> Model:
    """Fit on rows of ``FEATURES`` and a 0/1 label; rows with any other label are left out.

    Without rows scores are 0.5; with one class alone they are that class.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("c")).agg(
        F.count("*").alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs)
    )
    got = {r["c"]: r for r in sums.collect()}
    if len(got) < 2:
        return Model([], [], [], [], [], only=0.5 if not got else float(next(iter(got))))
    n = np.array([got[c]["n"] for c in (0, 1)], float)
    mean = np.array([[got[c][f"s{i}"] for i in range(d)] for c in (0, 1)]) / n[:, None]
    cov = np.empty((2, d, d))
    for c in (0, 1):
        for i, j in pairs:
            cov[c, i, j] = cov[c, j, i] = got[c][f"p{i}_{j}"] / n[c] - mean[c, i] * mean[c, j]
    centre = (n[:, None] * mean).sum(0) / n.sum()
    pooled = (n[:, None, None] * cov).sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    outer = scale[:, None] * scale
    factors, constants = [], []
    for c in (0, 1):
        own = ((1 - POOLED) * cov[c] + POOLED * pooled) / outer
        own = (1 - RIDGE) * own + RIDGE * max(np.trace(own) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky((own + own.T) / 2 + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(lower).tolist())
        constants.append(math.log(n[c] / n.sum()) - float(np.log(np.diag(lower)).sum()))
    return Model(centre.tolist(), scale.tolist(), ((mean - centre) / scale).tolist(), factors, constants)


def probability(model: Model) -> Column:
    """Probability of label 1 over columns ``FEATURES``."""
    if model.only is not None:
        return F.lit(model.only)
    z = [(F.col(f) - F.lit(c)) / F.lit(s) for f, c, s in zip(FEATURES, model.centre, model.scale, strict=True)]
    log = []
    for mean, factor, constant in zip(model.means, model.factors, model.constants, strict=True):
        distance = F.lit(0.0)
        for i, row in enumerate(factor):
            part = F.lit(0.0)
            for j in range(i + 1):
                part = part + F.lit(row[j]) * (z[j] - F.lit(mean[j]))
            distance = distance + part * part
        log.append(F.lit(constant) - distance / 2)
    return 1 / (1 + F.exp(F.least(F.greatest(log[0] - log[1], F.lit(-700.0)), F.lit(700.0))))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, key: str, label: str) -> Model:
    """A model of the rows of ``stats`` (key and ``FEATURES``) that have a label and are not held out.

    A labelled row counts once for each of its documents; labels of null keys
    and null labels count for nothing.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    return learn(stats.join(known, F.col(key) == F.col("__key")).where(~held_out(F.col(key))), "__label")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Key, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``.

    Statistics are taken once and written to shared storage; the fit and the
    scores read them from there.
    """
    from epochal.llm import storage

    stats = storage.written(features(docs, key, text), "qda-features")
    model = fit(stats, labels, key, label)
    out = stats.select(key, held_out(F.col(key)).alias("held_out"), probability(model).cast("double").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose own text is scored one half or more.

    Each row is judged by itself, whatever its key: rows travel with their
    statistics, so nothing is shuffled but what the fit needs.
    """
    from epochal.llm import storage

    held = docs.select(F.struct(*docs.columns).alias("__row"), F.col(key).alias("__id"), F.col(text).alias("__text"))
    stats = storage.written(features(held, "__id", "__text", "__row"), "qda-rows")
    model = fit(stats.select(F.col("__id").alias(key), *FEATURES), labels, key, label)
    return stats.where(probability(model) >= 0.5).select("__row.*")
