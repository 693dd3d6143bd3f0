"""Toxicity by non-negative positive-unlabelled learning over hashed words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, materialize, operator, slabs, span_hashes, text_of, word_spans

#: Bits of a feature's number; lengths in bytes of word beginnings that are features.
BITS, BEGINNINGS = 20, (4, 5, 6, 7)
#: Sampled documents: confirmed toxic, and unlabelled; features of either that the driver holds, about (4 bytes each). Where there are more, fewer documents are drawn.
POSITIVES, UNLABELLED, HELD = 3000, 9000, 16_000_000

_LETTERS = np.ones(256, bool)  # what parts words: anything but ASCII letters and bytes of other scripts
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the features of each row, with repetitions: whole words, and beginnings of longer ones; lower case for A-Z."""
    begin, end, first = word_spans(data, offs, _LETTERS)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    rows, ids = [row], [span_hashes(data, begin, end, lower=True) >> shift]
    for n in BEGINNINGS:
        long = end - begin > n
        rows.append(row[long])
        ids.append((span_hashes(data, begin[long], begin[long] + n, lower=True) ^ np.uint64(n << 60)) >> shift)
    return np.concatenate(rows), np.concatenate(ids).astype(np.int64)


def _distinct(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows << BITS | ids)
    return both >> BITS, both & ((1 << BITS) - 1)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in slabs(batch.column(0)):
            rows, ids = _distinct(*_features(data, offs))
            ends = np.searchsorted(rows, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], ["features"])


@dataclass
class PuModel:
    """Weights by feature number (0 for those not weighed) and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        weighed = self.weights[ids] != 0
        rows, ids = _distinct(rows[weighed], ids[weighed])
        x = np.bincount(rows, self.weights[ids], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, rate: float = 0.05, penalty: float = 0.1) -> PuModel:
    """Logistic classifier on the presence of features that minimises the non-negative PU risk.

    risk = prior * R+(P) + max(0, R-(U) - prior * R-(P)). Where the corrected negative part falls below 0, a step goes up on that part
    instead, so that positives among the unlabelled aren't learned as negatives by heart. Squared weights are penalised by penalty over the number of positives.
    """
    size = 1 << BITS
    if not positive:
        return PuModel(np.zeros(size, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))) if 0 < prior < 1 else -10.0)
    n_p, n_u = len(positive), max(len(unlabelled), 1)
    in_p = np.bincount(np.concatenate(positive), minlength=size) / n_p
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size) / n_u if unlabelled else np.zeros(size)
    spread = np.sqrt((in_p * (1 - in_p) + 1 / n_p) / n_p + (in_u * (1 - in_u) + 1 / n_u) / n_u)
    strength = np.where(in_p * n_p >= 3, np.abs(in_p - in_u) / spread, 0)
    chosen = np.flatnonzero(strength > 2)
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))

    def packed(docs):
        rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        cols = place[np.concatenate(docs)] if docs else np.zeros(0, int)
        return rows[cols >= 0], cols[cols >= 0]

    (p_row, p_col), (u_row, u_col) = packed(positive), packed(unlabelled)
    w, b = np.zeros(len(chosen)), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, steps + 1):
        s_p = sigmoid(np.bincount(p_row, w[p_col], n_p) + b)
        s_u = sigmoid(np.bincount(u_row, w[u_col], n_u) + b)
        down_p, up_p, up_u = (s_p - 1) / n_p, s_p / n_p, s_u / n_u  # slopes of the losses at the outputs
        rest = -np.log(np.maximum(1 - s_u, 1e-12)).mean() - prior * -np.log(np.maximum(1 - s_p, 1e-12)).mean()
        if rest >= 0:
            g_p, g_u = prior * down_p - prior * up_p, up_u
        else:
            g_p, g_u = prior * up_p, -up_u
        grad = np.append(np.bincount(p_col, g_p[p_row], len(w)) + np.bincount(u_col, g_u[u_row], len(w)) + penalty / n_p * w, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(size, np.float32)
    weights[chosen] = w
    return PuModel(weights, float(b))


@operator
def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> PuModel:
    """From confirmed toxic documents and unlabelled text, with the share of toxic labels as the class prior; learn: usable ids, for labels and text.

    Null labels and ids teach nothing; of an id's labels the greatest counts; repeated rows and null or empty texts are drawn like any other; texts are read
    whole. Without a toxic label, or from empty tables, the model is a bias alone. Columns beyond the named ones are not looked at.
    """
    share = labels.where(learn & F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    toxic = labelled_sample(docs, labels.where(F.col(label) == 1), label, POSITIVES, learn, id_column, text_column)
    n = docs.where(learn).count()
    drawn = docs.where(learn).where(F.pmod(F.xxhash64(id_column, text_column), F.lit(1 << 30)) < int((1 << 30) * min(1.0, UNLABELLED / max(n, 1))))
    return train_pu(_gathered(toxic.select("text")), _gathered(drawn.select(text_of(text_column).alias("text"))), float(share or 0.0))


def _gathered(rows: DataFrame) -> list[np.ndarray]:
    """The distinct features of each of the sampled texts, of so many texts that the driver holds about HELD at most."""
    made = materialize(rows.mapInArrow(_lists, "features array<int>"))
    total = made.agg(F.sum(F.size("features"))).first()[0] or 0
    kept = made.where(F.pmod(F.xxhash64("features"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, HELD / max(total, 1)))) if total > HELD else made
    return sorted((x.values.to_numpy() for x in kept.toArrow().column(0)), key=lambda x: (len(x), x.tobytes()))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offs in slabs(batch.column(1)):
                scores = model.score(*_features(data, offs), hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scores)], ["ident", "score"])

    return run


@operator
def score_toxicity(docs: DataFrame, model: PuModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for each row, 0 to 1; a null or empty text has the bias alone; texts are read whole. Repeated rows and null ids are kept, empty tables give empty
    results, other columns are not looked at."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("ident"), text_of(text_column).alias("text"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"ident {kind}, score double").withColumnRenamed("ident", id_column)
