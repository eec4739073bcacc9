"""Severity grades by cumulative-link ordinal regression on sparse words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hortus.llm.common import materialise

_WORD = re.compile(r"\w+")
#: A document is rejected from the mark on that this share of the labelled toxic documents reaches when they
#: are held out, unless more than this share of the clean ones would reach it too.
RECALL, FALSE_ALARMS, FOLDS = 0.97, 0.03, 4


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class OrdinalModel:
    """P(grade >= k) = sigmoid(sum of the weights of a text's words - threshold k).

    One weight per word, shared by all ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float], mark: float = 0.5):
        self.weights, self.thresholds, self.mark = weights, thresholds, mark

    def at_least(self, text: str | None) -> list[float]:
        score = sum(self.weights[w] for w in self.weights.keys() & words(text))
        return [float(1 / (1 + np.exp(np.clip(t - score, -50, 50)))) for t in self.thresholds]


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3):
    """Maximum likelihood by Adam: (weights, increasing thresholds)."""
    n, f = x.shape
    p = np.zeros(f + grades - 1)
    share = np.array([(y >= k).mean() for k in range(1, grades)]).clip(1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    p[f] = cuts[0]
    p[f + 1:] = np.log(np.maximum(np.diff(cuts), 1e-2))
    m, v = np.zeros_like(p), np.zeros_like(p)

    def thresholds():
        return p[f] + np.concatenate([[0.0], np.cumsum(np.exp(p[f + 1:]))])

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    for step in range(1, steps + 1):
        edges = np.concatenate([[-np.inf], thresholds(), [np.inf]])
        eta = (x @ p[:f].astype(x.dtype)).astype(float)
        upper, lower = sigmoid(eta - edges[y]), sigmoid(eta - edges[y + 1])
        gap = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / gap, lower * (1 - lower) / gap
        du[y == 0], dl[y == grades - 1] = 0, 0
        g = np.zeros_like(p)
        g[:f] = -((du - dl).astype(x.dtype) @ x) / n + ridge * p[:f]
        at = np.array([(du * (y == k)).sum() - (dl * (y == k - 1)).sum() for k in range(1, grades)]) / n
        g[f] = at.sum()
        g[f + 1:] = [at[j + 1:].sum() * np.exp(p[f + 1 + j]) for j in range(grades - 2)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:f], thresholds().tolist()


def held_out_mark(x: np.ndarray, y: np.ndarray, grades: int, recall: float = RECALL, false_alarms: float = FALSE_ALARMS) -> float:
    """The probability of being toxic from which on a document is rejected.

    Every row is scored by a model that has not seen its fold.  With fewer
    toxic or clean rows than folds there is nothing to choose by: 0.5."""
    toxic = y > 0
    if min(toxic.sum(), (~toxic).sum()) < FOLDS:
        return 0.5
    fold, p = np.zeros(y.size, np.int64), np.zeros(y.size)
    for part in (toxic, ~toxic):  # each fold gets its share of both
        fold[part] = np.arange(part.sum()) % FOLDS
    for k in range(FOLDS):
        weights, cuts = fit_ordinal(x[fold != k], y[fold != k], grades)
        score = (x[fold == k] @ weights.astype(x.dtype)).astype(float)
        p[fold == k] = 1 / (1 + np.exp(np.clip(cuts[0] - score, -50, 50)))
    reached = np.sort(p[toxic])[int((1 - recall) * toxic.sum())]
    clean = np.sort(p[~toxic])[::-1]
    bound = clean[min(int(false_alarms * clean.size), clean.size - 1)]
    return float(reached if reached > bound else np.nextafter(bound, 2.0))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_words: int = 1024, least_z: float = 4.0) -> OrdinalModel:
    """Fits on at most ``max_rows`` labelled documents (those of smallest id hash).

    Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality (a null quality
    counts as not low).  Labels without an id or a toxic mark are left out;
    a document labelled twice takes its worst grade.  Of the sample's words
    those whose share differs between toxic and clean texts by ``least_z``
    deviations are features, the ``max_words`` clearest at most.  Without
    labelled toxic or clean texts the model rejects nothing."""
    grade = F.when(F.col("toxic") > 0, F.when(F.col("quality") <= 0, 2).otherwise(1)).otherwise(0)
    chosen = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "w": [sorted(words(t)) for t in b["text"]]})

    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
                         .mapInPandas(split, "doc_id long, grade int, w array<string>"), "sample")
    sizes = sample.agg(F.count_if(F.col("grade") > 0), F.count_if(F.col("grade") == 0)).first()
    n1, n0 = int(sizes[0]), int(sizes[1])
    if not n1 or not n0:
        return OrdinalModel({}, [50.0, 60.0])
    share = F.col("c") / F.lit(n1 + n0)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    seen = (sample.select("grade", F.explode("w").alias("word")).groupBy("word")
            .agg(F.count("*").alias("c"), F.count_if(F.col("grade") > 0).alias("c1"), F.count_if(F.col("grade") == 0).alias("c0"))
            .where(f"c >= 5 and c < {n1 + n0}").withColumn("z", F.abs(z)).where(F.col("z") >= least_z)
            .orderBy(F.desc("z"), "word").limit(max_words).select("word"))
    names = [r[0] for r in seen.collect()]  # max_words rows at most
    index = {w: i for i, w in enumerate(names)}
    rows = (sample.select("doc_id", "grade", F.explode_outer("w").alias("word"))
            .join(F.broadcast(seen.withColumn("used", F.lit(True))), "word", "left").groupBy("doc_id", "grade")
            .agg(F.collect_list(F.when(F.col("used"), F.col("word"))).alias("w")).orderBy("doc_id").collect())
    x, y = np.zeros((len(rows), len(names)), np.float32), np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):  # max_rows rows at most
        y[i] = r["grade"]
        x[i, [index[w] for w in r["w"]]] = 1
    weights, cuts = fit_ordinal(x, y, 3)
    return OrdinalModel({w: float(c) for w, c in zip(names, weights)}, cuts, held_out_mark(x, y, 3))


def severity(model: OrdinalModel):
    """Column function: text -> (severity: expected grade, p_toxic: P(grade >= 1))."""
    @pandas_udf("severity double, p_toxic double")
    def score(text: pd.Series) -> pd.DataFrame:
        p = [model.at_least(t) for t in text]
        return pd.DataFrame({"severity": [float(sum(q)) for q in p], "p_toxic": [q[0] for q in p]})
    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, severity, p_toxic, toxic for every row; toxic: p_toxic >= ``threshold``,
    by default the mark found on held-out labelled rows (``held_out_mark``).

    Null and empty texts have no words.  Repeated rows are scored alike, an
    empty table gives no rows, other columns are not looked at."""
    model = train(docs, labels)
    score, threshold = severity(model), model.mark if threshold is None else threshold
    return (docs.select("doc_id", score(F.col("text")).alias("s")).select("doc_id", "s.severity", "s.p_toxic")
            .withColumn("toxic", F.col("p_toxic") >= threshold))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are not toxic (as in ``score_documents``), columns unchanged."""
    model = train(docs, labels)
    score, threshold = severity(model), model.mark if threshold is None else threshold
    return docs.where(score(F.col("text"))["p_toxic"] < threshold)
