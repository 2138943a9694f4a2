"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: lower-case words and marks, and pairs and triples of token shapes (capitals, digits, marks,
a token like the one before). Each indicator is scaled by the n-gram's log-count ratio between the classes, and a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent. A logistic curve through margins of documents
the model has not seen turns a margin into a score. The fit uses a bounded sample of labelled rows (``SAMPLE``); scoring covers
whole texts.

Defined results: NULL and empty texts have no n-gram and score by the bias alone; without labelled rows of both classes every
document scores the share of ones (0 without labels); repeated rows are scored alike; labels of one document that disagree count
by majority, 1 on a tie; rows without an id are never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.llm.common import document_text, fold, free, labelled_sample
from sparcel.session import ship, written

#: Labelled documents the fit uses at most, and how many of them an n-gram must occur in.
SAMPLE, LEAST_DOCUMENTS = 8000, 8
#: Bound of the dual variables, and passes over the sample.
COST, PASSES = 0.01, 20
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+|\n")


@dataclass
class Model:
    """Weight of each n-gram (words as text, shapes as tuples), bias, and the curve's slope and offset; ``share`` without a fit."""

    words: dict[str, float] = field(default_factory=dict)
    shapes: dict[tuple[str, ...], float] = field(default_factory=dict)
    bias: float | None = None
    slope: float = 1.0
    offset: float = 0.0
    share: float = 0.0


def shape(token: str, before: str) -> str:
    if token == before:
        return "="
    first = token[0]
    if first.isalpha():
        return "a" if first.islower() else "A" if len(token) > 1 and token.isupper() else "Aa"
    return "0" if first.isalnum() else token[:4]


def ngrams(text: str | None) -> tuple[set[str], set[tuple[str, ...]]]:
    """The distinct words and marks of a text, and the distinct pairs and triples of shapes."""
    tokens = TOKEN.findall(text or "")
    shapes = list(map(shape, tokens, ["", *tokens]))
    grams = set(zip(shapes, shapes[1:]))
    grams.update(zip(shapes, shapes[1:], shapes[2:]))
    return set(map(str.lower, tokens)), grams


def _named(text: str | None) -> list[str]:
    """The n-grams as text: shapes are joined by spaces and begin with one, which no token has."""
    words, grams = ngrams(text)
    return sorted(words) + sorted(" " + " ".join(g) for g in grams)


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights (already times the ratio) and bias of the hinge-loss model over the scaled indicators in ``rows``."""
    sign = np.where(labels > 0, 1.0, -1.0)
    scaled = [ratio[r] for r in rows]
    norm = np.array([s @ s + 1 for s in scaled])
    weight, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (weight[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[rows[i]] += step * scaled[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return weight * ratio, bias


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, y in zip(rows, labels) if y == k)]), minlength=size) + 1.0 for k in (0, 1)]
    return np.log(counts[1] / (counts[1].sum())) - np.log(counts[0] / counts[0].sum())


def curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton's method with smoothed targets."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack((margins, np.ones_like(margins)), axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, size: int) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, slope and offset. Every fourth document is kept apart for the curve, then the model is fitted to all."""
    apart = np.arange(len(rows)) % 4 == 3
    if len(set(labels[apart])) == 2 == len(set(labels[~apart])):
        part = [r for r, a in zip(rows, apart) if not a]
        weight, bias = dual_coordinate_descent(part, labels[~apart], log_count_ratio(part, labels[~apart], size))
        slope, offset = curve(np.array([weight[r].sum() + bias for r, a in zip(rows, apart) if a]), labels[apart])
    else:
        slope, offset = 1.0, 0.0
    weight, bias = dual_coordinate_descent(rows, labels, log_count_ratio(rows, labels, size))
    return weight, bias, slope, offset


def fit_quality(documents: DataFrame, labels: DataFrame, held_out: Column | None = None, limit: int = SAMPLE) -> Model:
    """Fit on at most ``limit`` labelled documents outside ``held_out`` (a condition on ``doc_id``).

    The texts are cut up and counted on the executors; the driver gets the n-grams that occur in enough documents, at most as
    many as the sample has, and for each document the numbers of its n-grams.
    """
    ship(documents.sparkSession)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True)) if held_out is None else held_out
    sample = written(labelled_sample(documents, labels, "quality", held_out, limit), "sample")
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = classes.get(1, 0) / max(1, sum(classes.values()))
    if len(classes) < 2:
        return Model(share=share)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"grams": [_named(t) for t in f["text"]]})

    counts = sample.mapInPandas(grams, "grams array<string>").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    index = {g: i for i, g in enumerate(sorted(r["gram"] for r in counts.where(F.col("n") >= LEAST_DOCUMENTS).collect()))}

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "grams": [[index[g] for g in _named(t) if g in index] for t in f["text"]]})

    rows = sample.mapInPandas(numbered, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, grams array<int>").toPandas()
    rows = rows.sort_values("doc_id", key=lambda ids: pd.util.hash_array(ids.to_numpy()))
    weight, bias, slope, offset = fit_rows([np.asarray(g, np.int64) for g in rows["grams"]], rows["label"].to_numpy(), len(index))
    words = {g: float(weight[i]) for g, i in index.items() if g[0] != " " and weight[i]}
    shapes = {tuple(g[1:].split(" ")): float(weight[i]) for g, i in index.items() if g[0] == " " and weight[i]}
    return Model(words, shapes, bias, slope, offset, share)


def score_of(text: str | None, model: Model) -> float:
    if model.bias is None:
        return model.share
    words, shapes = ngrams(text)
    margin = model.bias + sum([model.words[w] for w in words if w in model.words]) + sum([model.shapes[s] for s in shapes if s in model.shapes])
    return float(1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -700, 700))))


def score_quality(documents: DataFrame, model: Model, name: str = "quality_score", text: str = "text") -> DataFrame:
    """``documents`` with the probability of label 1 in ``name``; a table that has such a column already is an error."""
    free(documents, name)
    ship(documents.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([score_of(t, model) for t in texts], dtype="float64")

    return documents.withColumn(name, F.pandas_udf(run, "double")(document_text(text)))
