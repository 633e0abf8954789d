"""Document quality by hierarchical empirical Bayes.

A classifier over the shape of a text gives each document's evidence, a log
likelihood ratio.  Its probabilities are summed over all documents of each host
and each path; a host's rate is shrunk to the global rate and a path's rate to
its host's, by strengths estimated from the spread between groups, so sparse
sites stay near their parents.  A document's score joins its own evidence with
the posterior of its path.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, id_bucket, packed, small_batches, unpacked
from .linear import Rows, fit, sigmoid
from .toxicity import HELD_OUT_MODULUS, HELD_OUT_REMAINDER, sample_rows

#: Most labelled rows that training reads; the first by hash of their id.
SAMPLE_ROWS = 16_000
BINS = 16
THRESHOLD = 0.5
#: Limits of the strengths with which groups are shrunk, in documents.
STRENGTH = (2.0, 10_000.0)
#: Evidence is held to this many nats either way.
MAX_EVIDENCE = 20.0
_UPPER, _DIGIT = np.r_[65:91], np.r_[48:58]
_LETTER = np.r_[65:91, 97:123, 128:256]
_SYMBOL = np.frombuffer(b"#$%&*+<=>@\\^_`{|}~", np.uint8)
_STOP, _SHOUT = np.frombuffer(b".,;:?", np.uint8), np.frombuffer(b"!", np.uint8)


def shape(text: bytes | None) -> list[float]:
    """Numbers of a whole text: sizes, shares of kinds of characters, repetition."""
    text = text or b""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(count[_LETTER].sum()))
    lines = text.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = sum(map(bytes.__eq__, words, words[2:]))
    return [
        math.log1p(len(words)),
        len(text) / n,
        count[_UPPER].sum() / letters,
        count[_DIGIT].sum() / size,
        count[_SYMBOL].sum() / n,
        count[_SHOUT].sum() / n,
        count[_STOP].sum() / n,
        letters / size,
        len(set(words)) / n,
        len(set(words)) / math.sqrt(n),
        same / n,
        pairs / n,
        len(set(lines)) / len(lines),
        len(lines) / n,
    ]


class Model:
    """Additive over binned numbers: ``edges`` by feature, weights by feature and bin."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, intercept: float, base: float):
        self.edges, self.weights, self.intercept, self.base = edges, weights, intercept, base

    def evidence(self, shapes: np.ndarray) -> np.ndarray:
        """Log likelihood ratio: the classifier's log odds less those of its training rows."""
        logit = np.full(len(shapes), self.intercept)
        for j, edges in enumerate(self.edges):
            logit += self.weights[j][np.searchsorted(edges, shapes[:, j], "right")]
        return np.clip(logit - self.base, -MAX_EVIDENCE, MAX_EVIDENCE)


def train(shapes: np.ndarray, y: np.ndarray) -> Model:
    width = shapes.shape[1]
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = math.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((width, BINS - 1)), np.zeros((width, BINS)), base, base)
    # the rarer class has its own say in where bins begin
    marks = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
    edges = np.array([np.sort(np.r_[np.quantile(x, marks), np.quantile(x[y < 0.5], np.r_[marks, 0.02])]) for x in shapes.T])
    numbered = np.stack([j * BINS + np.searchsorted(edges[j], shapes[:, j], "right") for j in range(width)], 1)
    w, b = fit(Rows(list(numbered)), y, width * BINS, l2=1e-4)
    return Model(edges, w.reshape(width, BINS), b, base)


def train_model(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", label_id: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_ROWS) -> Model:
    small_batches(docs.sparkSession)
    sample = sample_rows(docs, labels, label, id_col, label_id, text_col, bound, HELD_OUT_MODULUS, HELD_OUT_REMAINDER)

    def extract(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shape(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sorted((tuple(r["x"]), r["y"]) for r in sample.mapInArrow(extract, "x array<double>, y int").toArrow().to_pylist())
    shapes = np.array([x for x, _ in rows], float).reshape(-1, len(shape(b"")))
    return train(shapes, np.array([y for _, y in rows], float))


def with_evidence(docs: DataFrame, model: Model, text_col: str, row: Column, keep_text: bool) -> DataFrame:
    """``(row, evidence)``, with ``keep_text`` also ``text``: what is to stay of each row, and its
    evidence.  Each text is read once and goes to the worker once."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    source = docs.select(row.alias("row"), column(text_col).alias("text"))

    def run(batches):
        reader = Model(**shared.value)
        for batch in batches:
            shapes = np.array([shape(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], float).reshape(batch.num_rows, -1)
            values = reader.evidence(shapes) if batch.num_rows else np.empty(0)
            columns = [batch.column(0), pa.array(values, pa.float64()), *([batch.column(1)] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["row", "evidence", *(["text"] if keep_text else [])]
    out = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("evidence", T.DoubleType()), *([T.StructField("text", T.StringType())] if keep_text else [])])
    return source.mapInArrow(run, out)


def _strength(groups: DataFrame, parent: str) -> float:
    """Beta prior strength of groups around their parents' rates, by moments: of the
    spread between rates, what sampling doesn't explain is left to the groups."""
    r = F.col(parent)
    row = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - r, 2)).alias("spread"),
        F.sum(r * (1 - r)).alias("sampling"),
        F.sum(F.col("n") * r * (1 - r)).alias("binomial"),
    ).first()
    if not row["binomial"]:
        return STRENGTH[1]
    between = max(0.0, row["spread"] - row["sampling"]) / row["binomial"]
    return min(STRENGTH[1], max(STRENGTH[0], 1 / max(between, 1e-12) - 1))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def path_posteriors(evidence: DataFrame, base: float) -> DataFrame:
    """``evidence(host, path, evidence)`` to ``(host, path, host_posterior, path_posterior)``."""
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(base))))
    paths = cut(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("good")), "paths")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = whole["good"] / whole["n"] if whole["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.lit(rate))
    hosts = cut(hosts, "hosts")
    k = _strength(hosts, "rate")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + F.lit(k * rate)) / (F.col("n") + F.lit(k))).alias("host_posterior"))
    placed = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "good", "host_posterior"), "placed")
    k = _strength(placed, "host_posterior")
    posterior = (F.col("good") + F.lit(k) * F.col("host_posterior")) / (F.col("n") + F.lit(k))
    return cut(placed.select("host", "path", "host_posterior", posterior.alias("path_posterior")), "posteriors")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, row: Column, keep_text: bool, model: Model | None) -> DataFrame:
    """``(row, evidence, host_posterior, path_posterior, score)`` and, with ``keep_text``, ``text``;
    ``row.it`` is the given row.  The texts are judged once: what comes of it is
    stored and read twice."""
    model = model or train_model(docs, labels, id_col=id_col, text_col=text_col)
    site = lambda name: column(name).cast("string")
    read = cut(with_evidence(docs, model, text_col, F.struct(row.alias("it"), site(host_col).alias("host"), site(path_col).alias("path")), keep_text), "evidence")
    posteriors = path_posteriors(read.select("row.host", "row.path", "evidence"), model.base)
    joined = read.join(posteriors, F.col("row.host").eqNullSafe(F.col("host")) & F.col("row.path").eqNullSafe(F.col("path")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior")))))
    return joined.select(F.col("row.it").alias("row"), *(["text"] if keep_text else []), "evidence", "host_posterior", "path_posterior", score.alias("score"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, evidence, host_posterior, path_posterior, score, keep)``, one row for each input row.

    Labels are learned from ids whose crc32 leaves a remainder other than 0 by
    5; an id labelled more than once has its highest label.  Null and empty
    texts are judged as texts without words; a null host or path is a site of
    its own; repeated rows are judged alike, each one of its site's rows;
    without labels of both kinds there is no evidence and every score is the
    prior; an empty table gives no rows.  Other columns are not read.
    """
    judged = _judged(docs, labels, id_col, text_col, host_col, path_col, column(id_col), False, model)
    return judged.select(F.col("row").alias("doc_id"), "evidence", "host_posterior", "path_posterior", "score").select(
        "doc_id", (id_bucket("doc_id", HELD_OUT_MODULUS) == HELD_OUT_REMAINDER).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """The rows that are kept, with the columns they came with, whatever their names; nulls,
    repeats and empty tables as in :func:`quality`."""
    judged = _judged(docs, labels, id_col, text_col, host_col, path_col, packed(docs, (text_col,)), True, model)
    return judged.where(F.col("score") >= threshold).select(*unpacked(docs, F.col("row"), {text_col: F.col("text")}))
