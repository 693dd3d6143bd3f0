"""Language identification by the nearest of several centroids a language, over TF-IDF vectors of hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, operator, slabs, text_of

#: Hashed features; centroids a language; sampled documents a language that centroids are fitted on, and in all.
FEATURES, CENTROIDS, SAMPLE, SAMPLE_ALL = 8192, 4, 400, 4000
#: A document is rejected if its cosine falls below this share of what nearly all sampled documents of the language have.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.01
UNKNOWN = "und"
#: Rows whose counts are held at once: some 4 MB.
ROWS = 64

#: Bytes as features see them: letters in lower case and all bytes of other scripts; anything else is a space.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[[*range(65, 91), *range(97, 123)]] = ASCII_LOWER[[*range(65, 91), *range(97, 123)]]
_SEEN[128:] = np.arange(128, 256)


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Features of the 1-, 2- and 3-byte sequences that begin at each byte; 0 for what is nothing but spaces."""
    x = _SEEN[data].astype(np.uint32)
    raised = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)  # capitals of Latin-1 letters
    x[1:][raised] += 32
    grams, step = [], x
    for n in (1, 2, 3):
        if n > 1:
            step = step[: len(step) - 1] * np.uint32(263) + x[n - 1 :] if len(step) else step
        empty = step == {1: 32, 2: 32 * 264, 3: 32 * (263 * 264 + 1)}[n]
        ids = (step * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(19)
        ids[empty] = 0
        grams.append(ids)
    return grams


def _counts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of the features of ROWS rows at a time: the first row's number, and a matrix."""
    grams, rows = _grams(data), len(offs) - 1
    for lo in range(0, rows, ROWS):
        total = np.zeros((min(ROWS, rows - lo), FEATURES), np.int64)
        for own, begin, end in zip(total, offs[lo:].tolist(), offs[lo + 1 :].tolist(), strict=False):
            for n, ids in enumerate(grams):
                if end - n > begin:
                    own += np.bincount(ids[begin : end - n], minlength=FEATURES)
        total[:, 0] = 0
        yield lo, total


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for _, _, data, offs in slabs(batch.column(0)):
            for _, counts in _counts(data, offs):
                seen += (counts > 0).sum(0)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, data, offs in slabs(batch.column(1)):
            for at, counts in _counts(data, offs):
                row, feature = np.nonzero(counts)
                ends = pa.array(np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (feature, counts[row, feature])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + at, len(counts)), *lists], ["lang", "features", "counts"])


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * np.sqrt(idf)  # counts as they are: of a text in two languages the larger part decides
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows by cosine; each starts at the row least like those before."""
    mean = x.mean(0)
    centroids = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centroids) < min(k, len(x)):
        centroids.append(x[np.argmin((x @ np.array(centroids).T).max(1))])
    c = np.array(centroids)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, cosines, and whether the nearest centroid is too far."""
        likes = _weighted(counts, self.idf) @ self.centroids.T
        at = likes.argmax(1)
        own, score = self.owner[at], np.clip(likes[np.arange(len(at)), at], 0, 1)
        return own, score, score < self.least[own]


@operator
def fit_languages(docs: DataFrame, learn: Column, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> LanguageModel | None:
    """Document frequencies over all rows that may be learned from, centroids from a bounded sample with a row of each language at least.

    None if there are no such rows, as in an empty table. Rows with a null lang, or without letters, teach nothing; repeated rows count each; null ids may be
    learned from where learn says so. Texts are read whole, however long; columns beyond the three named ones are not looked at.
    """
    rows = docs.where(learn & F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}")).select(F.col(id_column).alias("ident"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("ident", "text"), F.lit(1 << 62)).alias("draw"))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()}
    if not sizes:
        return None
    seen = np.zeros(FEATURES)
    for r in rows.select("text").mapInArrow(_document_counts, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        seen[r["feature"]] = r["n"]
    idf = np.where(seen > 0, np.log((sum(n for n, _ in sizes.values()) + 1) / (seen + 1)) + 0.05, 0)
    each = max(1, min(SAMPLE, SAMPLE_ALL // len(sizes)))
    # A language's least draw always counts, so that none goes without a row.
    share = F.create_map(*[F.lit(x) for lang, (n, least) in sizes.items() for x in (lang, max(least, int((1 << 62) * min(1.0, each / n))))])
    drawn = rows.where(F.col("draw") <= share[F.col("lang")]).select("lang", "text").mapInArrow(_sparse, "lang string, features array<int>, counts array<int>").toArrow()
    langs = np.array(drawn.column("lang").to_pylist(), object)
    dense = np.zeros((len(langs), FEATURES), np.float32)
    for i, (f, c) in enumerate(zip(drawn.column("features"), drawn.column("counts"), strict=True)):
        dense[i, f.values.to_numpy()] = c.values.to_numpy()
    vectors = _weighted(dense, idf)
    known = sorted(set(langs.tolist()))
    if not known:
        return None
    centroids = [_cluster(vectors[langs == x], CENTROIDS) for x in known]
    least = np.array([REJECT_SHARE * np.quantile((vectors[langs == x] @ c.T).max(1), REJECT_QUANTILE) for x, c in zip(known, centroids, strict=True)])
    return LanguageModel(known, idf.astype(np.float32), np.concatenate(centroids).astype(np.float32), np.repeat(np.arange(len(known)), [len(c) for c in centroids]), least)


def _predict(shared, text_field: str | None):
    """Rows (carried, letters, and text, unless that is the named field of carried)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel | None = shared.value
        for batch in batches:
            text = batch.column(0).field(text_field) if text_field else batch.column(2)
            for lo, hi, data, offs in slabs(text):
                letters = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                langs, scores, far = [UNKNOWN] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
                for at, counts in _counts(data, offs) if model else ():
                    own, score, reject = model.predict(counts.astype(np.float32))
                    for i in np.flatnonzero(letters[at : at + len(own)]):
                        langs[at + i], scores[at + i], far[at + i] = model.languages[own[i]], score[i], reject[i]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores), pa.array(far)], ["carried", "lang_pred", "score", "rejected"])

    return run


@operator
def predict_languages(docs: DataFrame, model: LanguageModel | None, carried: Column, text_column: str = "text") -> DataFrame:
    """(carried, lang_pred, score, rejected) for each row.

    lang_pred is a learned language, or `und` if the text is null or has no letter (or nothing was learned); score is the cosine to the
    nearest centroid, 0 for `und`; of equal cosines the language first in order counts. Texts are read whole, however long; other columns are not looked at. rejected: `und`, or farther from its
    language than nearly all sampled documents are. Each row stands for itself: repeated rows and null ids are kept; empty tables give empty results.
    """
    return _predicted(docs, model, carried, text_column, None)


def _predicted(docs: DataFrame, model: LanguageModel | None, carried: Column, text_column: str, text_field: str | None) -> DataFrame:
    letters = F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select(carried.alias("carried"), letters, *([] if text_field else [text_of(text_column).alias("text")]))
    shape = T.StructType([T.StructField("carried", rows.schema["carried"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), text_field), shape)


@operator
def keep_known(docs: DataFrame, learn: Column, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """The rows of docs that are not rejected, columns as they are, extra ones of any name too.

    Null texts and texts without letters go, as do all rows where nothing could be learned; repeated rows and null ids are judged one by one, an empty
    table stays empty, long texts are read whole.
    """
    model = fit_languages(docs, learn, text_column, lang_column, id_column)
    return _predicted(docs, model, F.struct("*"), text_column, text_column).where("NOT rejected").select("carried.*")
