"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is logistic in its distinct words; a document is toxic if any sentence is, so its probability is the
noisy-or ``1 - prod(1 - p)`` over its sentences. The weights maximise the likelihood of the *document* labels, which is enough
to tell the sentences apart. The fit uses a bounded sample of labelled rows (``SAMPLE``); scoring covers whole texts.

Defined results: NULL and empty texts, and texts without a word, have no sentence and score 0; without labelled rows of both
classes every document scores the share of ones (0 without labels); repeated rows are scored alike; labels of one document that
disagree count by majority, 1 on a tie; rows without an id are never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.llm.common import document_text, fold, free, fresh, labelled_sample
from sparcel.session import ship, written

#: Labelled documents the fit uses at most.
SAMPLE = 16_000
#: A word counts if it occurs in so many of them, and if its odds of standing in a toxic one (a clean one added) are so many times
#: the odds of all documents.
LEAST_DOCUMENTS, LIFT = 6, 4
RIDGE = 0.05
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    """Log-odds of a sentence: ``bias`` plus the weights of its distinct words; ``share`` is used without a fit."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float | None = None
    share: float = 0.0


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence that has a word; positions are code points."""
    for m in SENTENCE.finditer(text or ""):
        if words := set(WORD.findall(m.group().lower())):
            yield m.start(), m.end(), words


def fit_bags(bags: list[list[list[int]]], plain: np.ndarray, labels: np.ndarray, size: int, rounds: int = 120, rate: float = 0.3) -> np.ndarray:
    """Weights of ``size`` words, and the bias, that maximise the noisy-or likelihood of the labels (Adam over the whole sample).

    ``bags`` has for each document the words of its sentences, ``plain`` the number of its sentences without any of them.
    """
    y = labels.astype(bool)
    owner = np.repeat(np.arange(len(bags)), [len(doc) for doc in bags])
    flat = [b for doc in bags for b in doc]
    row = np.repeat(np.arange(len(flat)), [len(b) for b in flat])
    column = np.array([i for b in flat for i in b], np.int64)
    theta = np.append(np.zeros(size), np.log(y.mean() / max(1.0, (len(flat) + plain.sum()) / len(bags))))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(row, theta[column], len(flat))
        p, p_plain = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + np.exp(-theta[-1]))
        # log of the probability that no sentence is toxic
        clean = -np.bincount(owner, np.logaddexp(0, z), len(bags)) - plain * np.logaddexp(0, theta[-1])
        slope = np.where(y, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), 1.0)
        each = p * slope[owner]
        gradient = np.append(np.bincount(column, each[row], size) + RIDGE * theta[:-1], each.sum() + (slope * plain).sum() * p_plain)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta = theta - rate * min(1.0, 2 - 2 * step / rounds) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return theta


def sentence_scores(text: str | None, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, log-odds) of each sentence."""
    get = model.weights
    return [(start, end, model.bias + sum([get[w] for w in words if w in get])) for start, end, words in sentences(text)]


def fit_toxicity(documents: DataFrame, labels: DataFrame, held_out: Column | None = None, limit: int = SAMPLE) -> Model:
    """Fit on at most ``limit`` labelled documents outside ``held_out`` (a condition on ``doc_id``).

    The texts are cut up on the executors; the driver gets the words that tell the classes apart, at most as many as the sample
    has, and for each document the numbers of those words by sentence.
    """
    ship(documents.sparkSession)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True)) if held_out is None else held_out
    sample = written(labelled_sample(documents, labels, "toxic", held_out, limit), "sample")
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = classes.get(1, 0) / max(1, sum(classes.values()))
    if len(classes) < 2:
        return Model(share=share)

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"label": f["label"], "words": [sorted(set().union(*(w for _, _, w in sentences(t)))) for t in f["text"]]})

    counts = sample.mapInPandas(words, "label int, words array<string>").select("label", F.explode("words").alias("word"))
    counts = counts.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    odds = share / (1 - share)
    telling = counts.where((F.col("n") >= LEAST_DOCUMENTS) & (F.col("k") >= LIFT * odds * (F.col("n") - F.col("k") + 1))).select("word")
    index = {w: i for i, w in enumerate(sorted(r["word"] for r in telling.collect()))}

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [[[index[w] for w in sorted(s) if w in index] for _, _, s in sentences(t)] for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "bags": [[b for b in d if b] for d in found], "plain": [sum(not b for b in d) for d in found]})

    rows = sample.mapInPandas(bags, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, bags array<array<int>>, plain bigint").toPandas().sort_values("doc_id")
    theta = fit_bags([[list(b) for b in d] for d in rows["bags"]], rows["plain"].to_numpy(float), rows["label"].to_numpy(), len(index))
    return Model({w: float(theta[i]) for w, i in index.items()}, float(theta[-1]), share)


def score_toxicity(documents: DataFrame, model: Model, name: str = "toxicity", text: str = "text") -> DataFrame:
    """``documents`` with a struct ``name``: ``score``, and the ``start``, ``end``, ``score`` of every sentence at 0.5 or more.

    A table that has a column ``name`` already is an error.
    """
    free(documents, name)
    ship(documents.sparkSession)

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if model.bias is None:
                rows.append((model.share, []))
                continue
            found = sentence_scores(t, model)
            z = np.array([s for _, _, s in found])
            offending = [{"start": a, "end": b, "score": float(1 / (1 + np.exp(-s)))} for a, b, s in found if s >= 0]
            rows.append((float(-np.expm1(-np.logaddexp(0, z).sum())), offending))
        return pd.DataFrame(rows, columns=["score", "offending"])

    kind = "struct<score: double, offending: array<struct<start: int, end: int, score: double>>>"
    return documents.withColumn(name, F.pandas_udf(run, kind)(document_text(text)))


def drop_toxic(documents: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``documents`` whose score is below ``threshold``."""
    mark = fresh(documents, "toxicity")
    return score_toxicity(documents, model, mark, text).where(F.col(f"{mark}.score") < threshold).drop(mark)
