"""Toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespace.llm.common import free_name, keep, ready

#: Word beginnings of these lengths are features beside whole words: they catch inflected and compound forms.
PREFIXES = (3, 4, 5, 6)
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"
REMEMBERED = 400_000
#: Probability of any toxic grade from which a document counts as toxic (chosen on labels held out of the fit).
THRESHOLD = 0.25


def word_features(word: str) -> tuple[str, ...]:
    w = word.strip(_EDGE)
    return (w + "$", *(w[:k] for k in PREFIXES if len(w) > k)) if w else ()


def features(text: str | None) -> set[str]:
    """Lower-case words and beginnings of words that occur in a text."""
    return {f for w in set((text or "").lower().split()) for f in word_features(w)}


@dataclass
class OrdinalModel:
    """``P(grade <= k) = 1 / (1 + exp(x . w - cut_k))``, one weight vector for all thresholds, cuts rising."""

    weights: dict[str, float] = field(default_factory=dict)
    cuts: tuple[float, ...] = (50.0, 51.0, 52.0)

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.cuts) - np.asarray(scores)[:, None], -60, 60)))


class WordHits(dict):
    """For a word, the weighted features it shows; words met before are remembered up to a bound."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        got = tuple(f for f in word_features(word) if f in self.weights)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got

    def of(self, text: str | None) -> set[str]:
        return set().union(*filter(None, map(self.__getitem__, set((text or "").lower().split()))))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, width: int, levels: int, steps: int = 250, penalty: float = 0.0003, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising cuts that make the mean log-likelihood less ``penalty / 2`` times the squared weights large, by
    Adam; ``rows`` hold the present features' numbers."""
    n = len(rows)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    feat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    share = np.clip([np.mean(grades > k) for k in range(levels - 1)], 1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, gaps = theta[:width], np.exp(theta[width + 1 :])
        cuts = theta[width] + np.concatenate([[0], np.cumsum(gaps)])
        x = np.bincount(doc, w[feat], n)
        above = 1 / (1 + np.exp(-np.clip(x[:, None] - cuts, -60, 60)))  # P(grade > k)
        lo = np.where(grades > 0, above[np.arange(n), np.maximum(grades - 1, 0)], 1.0)
        hi = np.where(grades < levels - 1, above[np.arange(n), np.minimum(grades, levels - 2)], 0.0)
        p = np.maximum(lo - hi, 1e-9)
        # derivatives of log(lo - hi) by the score and by the two cuts
        dlo, dhi = lo * (1 - lo) / p, hi * (1 - hi) / p
        gx = dlo - dhi
        gcut = np.zeros(levels - 1)
        np.add.at(gcut, grades[grades > 0] - 1, -dlo[grades > 0])
        np.add.at(gcut, grades[grades < levels - 1], dhi[grades < levels - 1])
        tail = np.cumsum(gcut[::-1])[::-1]
        g = np.concatenate([np.bincount(feat, gx[doc], width) / n - penalty * w, tail[:1] / n, tail[1:] * gaps / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:width], theta[width] + np.concatenate([[0], np.cumsum(np.exp(theta[width + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, vocabulary: int = 2048, often: tuple[int, int] = (4, 30), odds: float = 2.0, levels: int = 4, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents, those whose ids hash least, with at most ``vocabulary`` features: those
    that ``often[0]`` toxic or ``often[1]`` other documents show and whose logarithmic odds ratio exceeds ``odds``. On
    halves of the labels of the 10,000-document table, two toxic documents in place of four, or 4,096 features, change
    recall by 0.08 at most.

    Labels are 0 or 1, so the grades of toxic documents are derived: features that are much more frequent in toxic
    documents are cues, and toxic documents are graded 1 to ``levels`` - 1 by equal shares of their number of cues.
    Null labels and ids are left out; of several labels of one id the greatest counts. Without documents of both
    kinds, everything is grade 0.
    """
    ready(docs.sparkSession)
    ids = labels.select(F.col(doc_id).alias("lid"), F.col(label).cast("int").alias("y")).dropna().groupBy("lid").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("lid"), "lid").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(ids, F.col("id") == F.col("lid"))
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))  # an id may stand in many rows

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "y": pdf.y, "f": [sorted(features(t)) for t in pdf.text]})

    seen = keep(rows.mapInPandas(shown, rows.select("id", "y").schema.add("f", "string").simpleString()[7:-1].replace("f:string", "f:array<string>").replace(":", " ")))
    n1, n0 = (int(x or 0) for x in seen.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not n1 or not n0:
        return OrdinalModel()
    by = seen.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    ratio = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    top = by.filter((F.col("a") >= often[0]) | (F.col("b") >= often[1])).withColumn("odds", ratio).filter(F.abs("odds") > odds).orderBy((F.abs("odds") * F.sqrt(F.greatest("a", "b"))).desc(), "f").limit(vocabulary)
    chosen = {r.f: (k, r.odds, r.a) for k, r in enumerate(top.collect())}
    if not chosen:
        return OrdinalModel()
    sparse = seen.select("id", "y", F.array_intersect("f", F.array(*map(F.lit, chosen))).alias("f")).collect()  # bounded by the sample and the vocabulary
    sparse.sort(key=lambda r: (r.id, r.f))
    cues = {f for f, (_, o, a) in chosen.items() if o > 3 and f.endswith("$") or o > 4}
    hits = np.array([len(cues & set(r.f)) for r in sparse])
    y = np.array([r.y for r in sparse])
    grades = np.zeros(len(y), np.int64)
    toxic = np.flatnonzero(y > 0)
    place = np.argsort(np.argsort(hits[toxic], kind="stable"), kind="stable")
    grades[toxic] = 1 + place * (levels - 1) // max(1, len(toxic))
    w, cuts = fit_ordinal([np.array([chosen[f][0] for f in r.f], np.int64) for r in sparse], grades, len(chosen), levels)
    return OrdinalModel({f: float(w[k]) for f, (k, _, _) in chosen.items() if abs(w[k]) > 1e-3}, tuple(float(c) for c in cuts))


def grade(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD, text: str = "text", into: tuple[str, str, str] = ("severity", "grade", "toxic"), carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns if not given) and three more: expected severity, most probable grade, and whether the
    probability of any toxic grade reaches ``threshold``. Null or empty text shows no feature."""
    ready(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    src = free_name(docs, "src_text")
    rows = docs.select(*carry, F.col(text).alias(src))
    schema = rows.select(*carry).schema.add(into[0], "double").add(into[1], "integer").add(into[2], "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = WordHits(model.weights)
        for b in batches:
            x = np.array([sum(sorted(map(model.weights.get, hits.of(t.as_py())))) for t in b.column(b.num_columns - 1)], np.float64)
            above = model.exceed(x)
            p = -np.diff(np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1), axis=1)
            cols = [pa.array(np.round(above.sum(axis=1), 9)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that the model, fitted on ``labels``, finds toxic; columns stay as they are."""
    names = tuple(free_name(docs, n) for n in ("severity", "grade", "toxic"))
    return grade(docs, fit(docs, labels, text=text, **how), threshold, text, names).filter(~F.col(names[2])).select(*docs.columns)
