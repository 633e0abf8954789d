"""Toxicity by a counterfactual-regularised classifier.

A logistic classifier over the words of a text and their beginnings, trained on
a bounded sample of labelled rows.  Sampled texts that name a group are also
read with the identity terms swapped for others of their kind, and the training
loss penalises the change of the score, so that a group's name by itself
carries no weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, cut, id_bucket, lower_words, small_batches
from .linear import Rows, fit, sigmoid

#: Most labelled rows that training reads; the first by hash of their id.
SAMPLE_ROWS = 16_000
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 5, 0
#: Beginnings of words that are features too, in bytes: spelling families share them.
PREFIX_BYTES = (4, 5, 6)
FAIRNESS = 4.0
#: A toxic row counts as so many clean ones: toxic texts are rare, and one word can make them so.
POSITIVE_WEIGHT = 4.0
MIN_ROWS, MIN_Z, L2 = 4, 3.0, 1e-5
#: Most features of the model, a bound of its size: identity terms, then those that tell
#: the classes apart best.
MAX_FEATURES = 50_000

# Identity terms by kind; a term is swapped within its kind.
IDENTITY_TERMS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["mexican", "chinese", "american", "indian", "german", "french", "spanish"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["deaf", "blind", "disabled", "autistic"],
]
SWAPS = {a.encode(): kind[(i + 1) % len(kind)].encode() for kind in IDENTITY_TERMS for i, a in enumerate(kind)}


def features(words) -> np.ndarray:
    """Hashes of the distinct words and of their first bytes."""
    distinct = set(words)
    starts = {b"^" + w[:n] for w in distinct for n in PREFIX_BYTES if len(w) >= n}
    return np.fromiter(map(xxhash.xxh3_64_intdigest, [*distinct, *starts]), np.uint64, len(distinct) + len(starts))


#: Always weighed, so that a swap of terms can change a score and be penalised.
IDENTITY_FEATURES = sorted({int(f) for w in SWAPS for f in features([w]).view(np.int64)})


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, label_id: str, text_col: str, bound: int, modulus: int, remainder: int) -> DataFrame:
    """``(text, y)`` of at most ``bound`` labelled ids outside the held-out fold, by hash of the id."""
    ids = (
        labels.select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull())
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .where(id_bucket("id", modulus) != remainder)
        .orderBy(F.xxhash64("id"), "id")
        .limit(bound)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text"))
    # the ids are at most ``bound`` rows
    return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("text", "y")


class Model:
    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: bytes | None) -> float:
        get = self.weights.get
        return float(sigmoid(self.intercept + sum(get(f, 0.0) for f in features(lower_words(text)).tolist())))


def train(examples: list[tuple[np.ndarray, np.ndarray | None, int]], chosen: np.ndarray, fairness: float = FAIRNESS) -> tuple[dict[int, float], float]:
    """``examples``: features, features with identity terms swapped or None, label;
    ``chosen``: the features to weigh, sorted."""
    y = np.array([e[2] for e in examples], float)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return {}, float(np.log(rate / (1 - rate)))

    def numbered(hashes):
        if not len(chosen):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
        return at[chosen[at] == hashes]

    originals = np.array([i for i, e in enumerate(examples) if e[1] is not None], np.int64)
    swapped = Rows([numbered(examples[i][1]) for i in originals]) if len(originals) else None
    weight = np.where(y > 0, POSITIVE_WEIGHT, 1.0)
    w, b = fit(Rows([numbered(e[0]) for e in examples]), y, len(chosen), swapped, originals, fairness, L2, weight=weight)
    return dict(zip(chosen.tolist(), w.tolist())), b


def telling_features(rows: DataFrame) -> np.ndarray:
    """Of ``rows(f array<long>, y)``, the features whose share of toxic rows is far from
    the sample's, by a normal score, and the identity terms; counted over the cluster."""
    whole = rows.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    n, n1 = float(whole["n"] or 0), float(whole["toxic"] or 0)
    if not 0 < n1 < n:
        return np.empty(0, np.uint64)
    counted = rows.select(F.explode("f").alias("f"), "y").groupBy("f").agg(F.count("*").alias("have"), F.sum("y").alias("toxic"))
    share = F.col("have") / n
    z = F.abs(F.col("toxic") - n1 * share) / F.sqrt(F.lit(n1 * (1 - n1 / n)) * F.greatest(share * (1 - share), F.lit(1e-12)))
    named = F.col("f").isin(IDENTITY_FEATURES)
    best = counted.where(F.col("have") >= MIN_ROWS).select("f", z.alias("z"), named.alias("named")).where((F.col("z") >= MIN_Z) | F.col("named"))
    best = best.orderBy(F.col("named").desc(), F.col("z").desc(), "f").limit(MAX_FEATURES)
    return np.sort(best.select("f").toArrow().column(0).to_numpy().view(np.uint64))


def train_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", label_id: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_ROWS, fairness: float = FAIRNESS) -> Model:
    sample = sample_rows(docs, labels, label, id_col, label_id, text_col, bound, HELD_OUT_MODULUS, HELD_OUT_REMAINDER)
    longs = pa.list_(pa.int64())

    def extract(batches):
        for batch in batches:
            plain, other = [], []
            for t in batch.column(0).to_pylist():
                words = lower_words(t)
                plain.append(features(words).view(np.int64))
                other.append(features([SWAPS.get(w, w) for w in words]).view(np.int64) if not SWAPS.keys().isdisjoint(words) else None)
            yield pa.RecordBatch.from_arrays([pa.array(plain, longs), pa.array(other, longs), batch.column(1)], ["f", "s", "y"])

    small_batches(docs.sparkSession)
    rows = cut(sample.mapInArrow(extract, "f array<long>, s array<long>, y int"), "features")
    chosen = telling_features(rows.select("f", "y"))

    def narrow(batches):
        keep = lambda x: None if x is None else x[np.isin(x.view(np.uint64), chosen)]
        for batch in batches:
            columns = [[None if v is None else keep(np.array(v, np.int64)) for v in batch.column(i).to_pylist()] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, longs) for c in columns), batch.column(2)], ["f", "s", "y"])

    # what comes back is a few features for each row of the bounded sample
    examples = rows.mapInArrow(narrow, "f array<long>, s array<long>, y int").toArrow().to_pylist()
    read = lambda x: None if x is None else np.sort(np.array(x, np.int64).view(np.uint64))
    examples = sorted(((read(r["f"]), read(r["s"]), r["y"]) for r in examples), key=lambda e: (e[0].tobytes(), e[2]))
    return Model(*train(examples, chosen, fairness))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each input row.

    Labels are learned from ids whose crc32 leaves a remainder other than 0 by
    5; an id labelled more than once has its highest label.  Scores use the text
    alone: repeated rows score alike, null and empty texts score by the
    intercept.  Without labels of both kinds every score is the labelled rate
    (0.001 without any label); an empty table gives no rows.  Other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    model = model or train_model(docs, labels, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    id_type = docs.schema[id_col].dataType
    kind = to_arrow_type(id_type)
    source = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text"))

    def run(batches):
        reader = Model(*shared.value)
        for batch in batches:
            scores = [reader.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = source.mapInArrow(run, f"doc_id {id_type.simpleString()}, score double")
    return scored.select("doc_id", (id_bucket("doc_id", HELD_OUT_MODULUS) == HELD_OUT_REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
