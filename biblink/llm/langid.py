"""Language identification by a byte convolutional network, in numpy.

Filters of several widths slide over one-hot bytes, each filter's largest
response in a fixed-length window is kept, and a softmax layer reads them.  The
network is trained here, on windows of a bounded sample of labelled rows.  To
predict, a text's bytes are cut into windows that cover all of it, the windows
of many texts go through the network together, and their log probabilities are
averaged by text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, cut, id_bucket, small_batches

WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Rows per language that training reads, about: those with the smallest id hashes.
SAMPLE_PER_LANGUAGE = 600
#: Windows that training takes from one text at most, evenly spaced over the whole of it: a
#: bound of the training rows, which are windows.  Prediction reads all windows.
SAMPLE_WINDOWS = 8
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNDETERMINED = "und"
_BLOCK = 256
_HASHES = 1 << 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def windows(text: bytes) -> np.ndarray:
    """All bytes of a text in rows of ``WINDOW_BYTES``, the last one filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW_BYTES))
    return np.frombuffer(text.ljust(n * WINDOW_BYTES, b"\0"), np.uint8).reshape(n, WINDOW_BYTES)


class Network:
    """``filters[w]``: array (w, 256, FILTERS), a filter's weights by place and byte."""

    def __init__(self, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray):
        self.filters, self.bias, self.out, self.out_bias = filters, bias, out, out_bias

    @classmethod
    def initial(cls, classes: int, rng) -> Network:
        filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(filters, np.zeros(n, np.float32), rng.normal(0, 0.3, (n, classes)).astype(np.float32), np.zeros(classes, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def fold(self) -> None:
        """Tables over byte pairs, so that a filter of width w costs (w + 1) // 2 look-ups."""
        self.pairs = []
        for f in self.filters:
            tables = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, len(f) - 1, 2)]
            self.pairs.append((tables, f[-1] if len(f) % 2 else None))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.out_bias)), np.float32)
        for at in range(0, len(x), _BLOCK):
            part = np.ascontiguousarray(x[at : at + _BLOCK].T)
            pair = part[:-1].astype(np.int32) * 256 + part[1:]
            pooled = []
            for tables, single in self.pairs:
                width = 2 * len(tables) + (single is not None)
                long = WINDOW_BYTES - width + 1
                response = tables[0][pair[:long]]
                for i, t in enumerate(tables[1:], 1):
                    response += t[pair[2 * i : 2 * i + long]]
                if single is not None:
                    response += single[part[width - 1 : width - 1 + long]]
                pooled.append(response.max(0))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            out[at : at + _BLOCK] = log_softmax(hidden @ self.out + self.out_bias)
        return out


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n = len(x)
    rows = np.arange(n)
    pooled, places = [], []
    for f in net.filters:
        long = WINDOW_BYTES - len(f) + 1
        response = sum(f[j][x[:, j : j + long]] for j in range(len(f)))
        place = response.argmax(1)
        places.append(place)
        pooled.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0, :])
    before = np.concatenate(pooled, 1) + net.bias
    hidden = np.maximum(before, 0)
    error = np.exp(log_softmax(hidden @ net.out + net.out_bias))
    error[rows, y] -= 1
    error /= n
    back = (error @ net.out.T) * (before > 0)
    grads = []
    for i, f in enumerate(net.filters):
        g = np.zeros_like(f)
        mine = back[:, i * FILTERS : (i + 1) * FILTERS]
        columns = np.broadcast_to(np.arange(FILTERS), mine.shape)
        for j in range(len(f)):
            np.add.at(g[j], (x[rows[:, None], places[i] + j], columns), mine)
        grads.append(g)
    return [*grads, back.sum(0), hidden.T @ error, error.sum(0)]


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7) -> Network:
    """Adam over shuffled batches; classes weigh the same, by repeating windows of rare ones."""
    rng = np.random.default_rng(seed)
    net = Network.initial(classes, rng)
    m, v = ([np.zeros_like(a) for a in net.arrays()] for _ in range(2))
    of_class = [np.flatnonzero(y == c) for c in range(classes)]
    most = max(map(len, of_class))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(w), most) for w in of_class if len(w)]))
        for at in range(0, len(order), BATCH):
            t += 1
            some = order[at : at + BATCH]
            for a, g, m1, v1 in zip(net.arrays(), _gradients(net, x[some], y[some]), m, v):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                a -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.999**t)) + 1e-8)
    return net


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], Network | None]:
    """Languages, sorted, and the network; none without labelled rows."""
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("language"), as_bytes(text_col).alias("text")).where(
        F.col("language").isNotNull() & F.col("text").isNotNull() & (id_bucket("doc_id", HELD_OUT_MODULUS) != HELD_OUT_REMAINDER)
    )
    # stored, so that the planner sees how small it is and leaves the texts where they are
    counts = cut(labelled.groupBy("language").agg(F.count("*").alias("n")), "languages")
    low = F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)) * F.col("n") < F.lit(_HASHES * per_language)
    sample = labelled.join(counts, "language").where(low).select("language", "text")

    def extract(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                w = windows(t)
                some = np.unique(np.linspace(0, len(w) - 1, SAMPLE_WINDOWS).astype(int))
                # a last, mostly empty window says little where there are others
                some = some[some < len(w) - 1] if len(w) > 1 else some
                out.append(w[some].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["language", "x"])

    rows = sample.mapInArrow(extract, "language string, x binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["language"], r["x"]))
    languages = sorted({r["language"] for r in rows})
    if not languages:
        return [], None
    x = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(-1, WINDOW_BYTES) for r in rows])
    y = np.repeat([languages.index(r["language"]) for r in rows], [len(r["x"]) // WINDOW_BYTES for r in rows])
    return languages, train(x, y, len(languages))


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(texts: list[bytes | None], languages: list[str], net: Network | None) -> tuple[list[str], list[float]]:
    """Languages and their probabilities by averaged log probabilities of all windows."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    able = [i for i, t in enumerate(texts) if net is not None and t is not None and has_letter(t)]
    while able:
        # about 2 MB of windows at once, or one longer text
        size, take = 0, 0
        while take < len(able) and (not take or size + len(texts[able[take]]) <= 2 << 20):
            size += len(texts[able[take]])
            take += 1
        some, able = able[:take], able[take:]
        cut_up = [windows(texts[i]) for i in some]
        lens = np.array([len(w) for w in cut_up])
        sums = np.add.reduceat(net.log_probabilities(np.concatenate(cut_up)), np.cumsum(lens) - lens, axis=0)
        p = np.exp(log_softmax(sums / lens[:, None]))
        for i, best, value in zip(some, p.argmax(1).tolist(), p.max(1).tolist()):
            names[i], scores[i] = languages[best], min(1.0, value)
    return names, scores


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model=None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row for each input row.

    Languages are learned from rows with a language whose id's crc32 doesn't
    leave 2 by 4; predictions use the text alone, so repeated rows are judged
    alike.  Null texts and texts without a letter are ``und`` with score 0, as is
    everything if no row has a language; of equally likely languages the first
    by name is taken; an empty table gives no rows.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    languages, net = model or train_model(docs, id_col, text_col, lang_col)
    fields = (net.filters, net.bias, net.out, net.out_bias) if net else None
    shared = docs.sparkSession.sparkContext.broadcast((languages, fields))
    id_type = docs.schema[id_col].dataType
    kind = to_arrow_type(id_type)
    source = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text"))

    def run(batches):
        names, parts = shared.value
        reader = Network(*parts) if parts else None
        if reader:
            reader.fold()
        for batch in batches:
            found, scores = predict(batch.column(1).to_pylist(), names, reader)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    read = source.mapInArrow(run, f"doc_id {id_type.simpleString()}, lang_pred string, score double")
    return read.select("doc_id", (id_bucket("doc_id", HELD_OUT_MODULUS) == HELD_OUT_REMAINDER).alias("held_out"), "lang_pred", "score")
