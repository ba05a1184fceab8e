"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of a text.

Each class is a normal distribution whose covariance is shrunk towards the pooled one and then towards a sphere. Sums of
the statistics and of their products are gathered by Spark over every labelled row, so the driver sees two small
matrices whatever the input's size; it factors them once. A score is the logistic of the difference of the classes'
Mahalanobis log-densities, by the cached Cholesky factors, plus that of their shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperproof.llm.common import dropped, parts, stored

# The byte classes that are counted.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"!?", b"|", b"#$%&*@^~_<>\\{}[]`", b".,;:")
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c), _i] = 1
_TABLE[128:, len(_CLASSES)] = 1
NAMES = ("upper", "lines", "loud", "bar", "symbol", "stop", "beyond_ascii", "word_length", "short_words", "distinct", "repeated_lines", "repeated_words")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text; shares are taken to angles, means to logarithms.

    Shares are of a text that is a little longer, by ordinary words, so that a line or two, or nothing at all, looks ordinary.
    """
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE
    upper, lower, _, _, newline, loud, bar, symbol, stop, beyond = counts.tolist()
    w = raw.split()
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    lines = [x for x in raw.split(b"\n") if x]
    n, n_words, letters = len(raw) + 120, len(w) + 20, upper + lower + beyond + 100
    again = sum(map(len, lines)) - sum(map(len, set(lines)))
    shares = ((upper + 2) / letters, (newline + 1) / n_words, loud / n, bar / n, symbol / n, (stop + 3) / n, beyond / n)
    angle = [float(np.arcsin(np.sqrt(min(1.0, s)))) for s in shares]
    # the share of distinct words falls with length whatever the text; against this power of it, it hardly does
    more = [float(np.log(lengths.sum() + 100)) - float(np.log(n_words)), (float((lengths <= 3).sum()) + 9) / n_words, float(np.log1p((len(set(w)) + 18) / n_words**0.8)), again / (n + 400), sum(map(bytes.__eq__, w, w[1:])) / n_words]
    return [*angle, *more]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x for each row of docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            x = [statistics(t) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["doc_id"], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text, mod 3, is 1. A null id isn't held out, nor has it labels."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Per class its log share, mean, inverse Cholesky factor and log-determinant; without both classes, a constant score."""

    constant: float | None = None
    prior: np.ndarray | None = None
    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    log_det: np.ndarray | None = None
    temperature: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [self.prior[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) - 0.5 * self.log_det[k] for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / self.temperature, -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each label of labelled(x, label): rows, sums and sums of products. Tasks add up their own rows; sums of sums follow."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, d + 1, d + 1))
        for b in batches:
            x = np.concatenate((np.ones((len(b), 1)), np.asarray(b["x"].flatten()).reshape(-1, d)), axis=1)
            y = np.asarray(b["label"])
            for k in (0, 1):
                sums[k] += x[y == k].T @ x[y == k]
        k, i, j = np.nonzero(sums)
        yield pa.record_batch([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[k, i, j])], names=["k", "i", "j", "v"])

    sums = np.zeros((2, d + 1, d + 1))
    for r in labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(run, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.k, r.i, r.j] = r.v
    return {k: (sums[k, 0, 0], sums[k, 0, 1:], sums[k, 1:, 1:]) for k in (0, 1)}


def fitted(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], *, pool: float = 0.1, sphere: float = 0.02, temperature: float = 4.0) -> Model:
    """The model of some moments. pool: shrinkage to the pooled covariance; sphere: then to its mean variance. Both are
    taken where every statistic has pooled variance 1. temperature divides the log odds, so scores near 0 or 1 still differ."""
    n = np.array([sums[0][0], sums[1][0]])
    if n.min() < 2:
        return Model(constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = np.stack([sums[k][1] / n[k] for k in (0, 1)])
    cov = np.stack([sums[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    whiten, log_det = [], []
    for k in (0, 1):
        s = ((1 - pool) * cov[k] + pool * pooled) / np.outer(scale, scale)
        s = (1 - sphere) * s + sphere * max(np.trace(s) / len(s), 1e-9) * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(factor) / scale)
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Model(None, np.log(n / n.sum()), mean, np.stack(whiten), np.array(log_det), temperature)


def train(x: DataFrame, labels: DataFrame, label: str = "quality", **settings) -> Model:
    """The model of every row of features x whose id labels marks 0 or 1 and that isn't held out. Ids marked both ways, and null marks, don't count."""
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
    marks = marks.where("label = other").select("doc_id", "label")
    return fitted(moments(x.join(marks, "doc_id")), **settings)


def quality_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text, ...); labels(doc_id, quality, ...) may be empty.

    A null text is an empty one; both are scored like others. Only the text is an input of a score. Repeated rows are scored
    each; in learning they count each. Further columns of either table aren't read, and an empty table gives no rows. Without two rows of each label all scores are the share of label 1 (0.5 without labels).
    """
    x = stored(features(docs), "quality")
    model = train(x, labels, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.scores(np.asarray(b["x"].flatten()).reshape(-1, len(NAMES)))
            yield pa.record_batch([b["doc_id"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = x.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **settings) -> DataFrame:
    """The rows of docs with a score of at least ``least``, columns as they are. Rows are filtered where they are read; nulls, empty
    texts, repeated rows and missing labels as for quality_scores."""
    x = stored(features(docs), "quality")
    model = train(x, labels, **settings)
    dropped(x)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            score = model.scores(np.array([statistics(t) for t in b["text"].to_pylist()]))
            yield b.filter(pa.array(score >= least))

    return docs.mapInArrow(keep, docs.schema)
