"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words (A-Z lower-cased, cut at everything that is neither ASCII letter or digit nor
a byte from 128 on) and the words' first 4 and 5 bytes, hashed to ``2**BITS`` places. Those whose frequency
differs between toxic and clean documents (chi-squared of ``CHI`` or more) get weights. All thresholds share one weight vector: P(grade <= j) =
sigmoid(theta_j - w.x) with theta_0 < theta_1 < ...; the expected severity is the sum over j of P(grade > j).

Grades come from the labels: from their column ``grade`` if they have one. Otherwise a clean document has grade 0, and
toxic ones have 1, 2 or 3 by thirds of their evidence, the number of features that are at least ``ODDS`` times as common
in toxic as in clean documents of the sample. These thirds are evidence from the features that the model weighs, so
their scale is the model's own; a severity that means something else needs labels with grades. The model is fitted on a
bounded sample of labelled rows, ``SAMPLE`` labels (those with the smallest hash of their id) and ``SAMPLE`` rows of
``SAMPLE_BYTES`` at most in all (those with the smallest hash of their features, where ids repeat); everything is scored,
as a whole text.

Edge cases: null and empty texts have no features and get the severity of the thresholds alone; labels that are null or
belong to no document are not used; with no toxic or no clean label in the sample nothing is learned and no text is
rejected; repeated labels of a document count as often as they occur, as do repeated rows of a labelled id, within the
sample's bounds; extra columns pass through, those named like a result are replaced; an empty table gives an empty table.
A very long text is one row and must fit its task, with about 60 bytes for each of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import U, slices, tokens, utf8

BITS, SAMPLE, MIN_DF, RIDGE, ODDS, CHI = 22, 8192, 3, 0.05, 20, 8.0
PREFIXES = (4, 5)
#: Bytes of features that reach the driver at most, beside 12 for each row.
SAMPLE_BYTES = 256 << 20
#: P(grade > 0) from which a document is rejected.
REJECT = 0.5


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each distinct feature of each row, sorted."""
    h, counts = tokens(data, offs)
    row = np.repeat(np.arange(len(counts), dtype=U), counts) << U(BITS)
    key = np.unique(np.concatenate([row | (x >> U(64 - BITS)) for x in (h, *(tokens(data, offs, n)[0] for n in PREFIXES))]))
    return (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    thetas: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for every threshold j, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - score[:, None], -50, 50)))


def _loss(par: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, each: np.ndarray, dim: int, levels: int, ridge: float) -> tuple[float, np.ndarray]:
    w, raw = par[:dim], par[dim:]
    theta = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
    score = np.bincount(row, w[col], minlength=len(y))
    cdf = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -50, 50)))  # P(y <= j)
    full = np.concatenate((np.zeros((len(y), 1)), cdf, np.ones((len(y), 1))), 1)
    at = np.arange(len(y))
    p = np.maximum(full[at, y + 1] - full[at, y], 1e-12)
    slope = np.concatenate((np.zeros((len(y), 1)), cdf * (1 - cdf), np.zeros((len(y), 1))), 1)
    up, low = slope[at, y + 1] / p * each, slope[at, y] / p * each
    g_theta = np.zeros(levels + 2)
    np.add.at(g_theta, y + 1, -up)
    np.add.at(g_theta, y, low)
    g_theta = g_theta[1:-1]
    grad_raw = np.concatenate(([g_theta.sum()], np.exp(raw[1:]) * np.cumsum(g_theta[::-1])[::-1][1:]))
    grad_w = np.bincount(col, (up - low)[row], minlength=dim) + ridge * w
    return float(-(np.log(p) * each).sum() + 0.5 * ridge * w @ w), np.concatenate((grad_w, grad_raw))


def _minimise(f, x: np.ndarray, rounds: int = 150, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    fx, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y, r in reversed(steps):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(alphas), strict=True):
            d = d + s * (a - r * (y @ d))
        slope, t = g @ d, 1.0 if steps else min(1.0, 1 / max(np.abs(g).max(), 1e-12))
        while True:
            new = x + t * d
            f_new, g_new = f(new)
            if f_new <= fx + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = new - x, g_new - g
        if fx - f_new < 1e-7 * max(1.0, abs(fx)):
            return new if f_new < fx else x
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
        x, fx, g = new, f_new, g_new
    return x


def _flat(docs: list[np.ndarray], min_df: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of the features in ``min_df`` documents or more, and the features' names."""
    row = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    names, col, df = np.unique(np.concatenate([np.zeros(0, np.int32), *docs]), return_inverse=True, return_counts=True)
    keep = df >= min_df
    place = (np.cumsum(keep) - 1).astype(np.int32)
    used = keep[col]
    return row[used], place[col[used]], names[keep].astype(np.int64)


def _telling(row: np.ndarray, col: np.ndarray, names: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Only the features whose frequency differs between toxic and clean documents, by a chi-squared test."""
    n, t = len(toxic), int(toxic.sum())
    df = np.bincount(col, minlength=len(names)).astype(float)
    hit = np.bincount(col, toxic[row], minlength=len(names))
    want = df * t / n
    chi = (hit - want) ** 2 * (1 / want + 1 / np.maximum(df - want, 1e-9)) * n / np.maximum(n - df, 1)
    keep = chi >= CHI
    place, used = np.cumsum(keep) - 1, keep[col]
    return row[used].astype(np.int64), place[col[used]], names[keep]


def fit(docs: list[np.ndarray], grades: np.ndarray, min_df: int = MIN_DF, ridge: float = RIDGE) -> Model:
    """Fit on feature lists and grades 0, 1, ...; the classes toxic and clean get equal weight in sum."""
    levels, toxic = int(grades.max(initial=0)), grades > 0
    if not toxic.any() or toxic.all():
        return Model(np.zeros(1 << BITS), np.full(1, 50.0))
    row, col, names = _flat(docs, min_df)
    row, col, names = _telling(row, col, names, toxic)
    each = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    start = np.concatenate((np.zeros(len(names)), [0.5], np.zeros(levels - 1)))
    par = _minimise(lambda x: _loss(x, row, col, grades, each, len(names), levels, ridge), start)
    weights = np.zeros(1 << BITS)
    weights[names] = par[: len(names)]
    raw = par[len(names) :]
    return Model(weights, raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:])))))


def severity_grades(docs: list[np.ndarray], toxic: np.ndarray, min_df: int = MIN_DF) -> np.ndarray:
    """Grades 0 to 3 from labels 0 and 1, by thirds of evidence."""
    if not toxic.any():
        return toxic
    row, col, names = _flat(docs, min_df)
    bad = toxic[row] > 0
    among = [np.bincount(col[bad == k], minlength=len(names)) for k in (False, True)]
    odds = (among[1] + 0.5) / toxic.sum() / ((among[0] + 0.5) / max(int((toxic == 0).sum()), 1))
    mark = (odds >= ODDS) & (among[1] >= min_df)
    hits = np.bincount(row, mark[col], minlength=len(docs))
    low, high = np.quantile(hits[toxic > 0], [1 / 3, 2 / 3])
    grades = np.where(toxic > 0, 1 + (hits > low) + (hits > high), 0)
    return np.searchsorted(np.unique(np.append(grades, 0)), grades)  # without gaps


def _feature_lists(df: DataFrame) -> DataFrame:
    """``grade, features`` of the rows (text, grade); features as packed 32-bit numbers."""

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for a, b in slices(offs):
                row, col = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                packed = [x.astype(np.int32).tobytes() for x in np.split(col, np.searchsorted(row, np.arange(1, b - a)))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(packed, pa.binary())], names=["grade", "features"])

    return df.mapInArrow(run, "grade int, features binary")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents. Their feature lists are all that reaches the driver."""
    graded = "grade" in labels.columns
    grade = F.col("grade") if graded else F.col("toxic")
    chosen = labels.select(F.col(key).alias("__id"), grade.cast("int").alias("grade")).where("__id is not null and grade is not null")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "grade").limit(sample)
    rows = docs.select(docs[key].alias("__key"), docs[text].alias("__text")).join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select(F.col("__text").cast("string").alias("text"), "grade")
    lists = _feature_lists(rows).withColumn("h", F.xxhash64("features")).orderBy("h", "features", "grade").limit(sample)
    upto = F.sum(F.octet_length("features")).over(Window.orderBy("h", "features", "grade").rowsBetween(Window.unboundedPreceding, 0))  # of ``sample`` rows
    got = lists.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("features", "grade").collect()
    lists = [np.frombuffer(r.features, np.int32) for r in got]
    grades = np.array([r.grade for r in got], np.int64)
    if not graded:
        grades = severity_grades(lists, (grades > 0).astype(np.int64))
    order = sorted(range(len(got)), key=lambda i: (grades[i], lists[i].tobytes()))  # the same sum in any order of rows
    return fit([lists[i] for i in order], grades[order])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``severity`` (expected grade), ``p_toxic`` and ``grade`` (the most that is at least as likely as not)."""
    added = {"severity": T.DoubleType(), "p_toxic": T.DoubleType(), "grade": T.IntegerType()}
    keep = [c for c in df.columns if c not in added]
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(n, t) for n, t in added.items()])
    sent = df.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.thetas))  # 2**BITS floats

    def run(batches):
        m = sent.value
        for batch in batches:
            data, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            parts = []
            for a, b in slices(offs):
                row, col = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                parts.append(np.bincount(row, m.weights[col].astype(float), minlength=b - a))
            above = m.above(np.concatenate(parts) if parts else np.zeros(0))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            cols += [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array((above >= 0.5).sum(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)
