"""Centroids, nearest neighbours and combined scores over vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance, mean_of_present, outlier_reason
from ..scratch import settled
from .neighbours import BLOCK, nearest
from .relational import min_max_all


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows with sound vectors, and all others: null, empty, of another length than most, or with a null or non-finite component."""
    v = F.col(vector)
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(sound, F.lit(False))
    most = df.where(sound).groupBy(F.size(v).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    fine = sound & (F.size(v) == (most["n"] if most else 0))
    return df.where(fine), df.where(~F.coalesce(fine, F.lit(False)))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): mean vectors of non-null labels; partial sums of each position before the shuffle."""
    cells = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("_p", "_x"))
    means = cells.groupBy(label, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("centroid"))


def centroid_distance(df: DataFrame, label: str, vector: str, out: str = "centroid_distance") -> DataFrame:
    """df and the distance to the centroid of the row's label; null for a null label, and for vectors that usable() leaves out, which no centroid counts."""
    sound, others = usable(df, vector)
    means = centroids(sound, label, vector).select(F.col(label).alias("_label"), F.col("centroid").alias("_mean"))
    rows = sound.select(F.struct("*").alias("_row"), F.col(label).alias("_of"), F.col(vector).alias("_vec")).join(means, F.col("_of") == F.col("_label"), "left")
    kept = [c for c in df.columns if c != out]
    near = rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], distance(F.col("_vec"), F.col("_mean")).alias(out))
    return near.union(others.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("double").alias(out)))


def knn_distance(df: DataFrame, index: str, vector: str, k: int = 6, out: str = "knn_distance") -> DataFrame:
    """(index, distance to the k-th nearest vector, the row itself counted); the last one if there are fewer, null for vectors that usable() leaves out.

    Exact, by cells around pivots: a row is compared with its own block and with those that may hold a nearer vector; k distances a row meet at the end.
    """
    sound, others = usable(df, vector)
    near = nearest(sound.select(F.col(index).alias("_i"), F.col(vector).alias("_v")), k, block=BLOCK)
    none = others.where(F.col(vector).isNotNull()).select(F.col(index), F.lit(None).cast("double").alias(out))
    return near.select(F.col("_i").alias(index), F.element_at("near", -1)["d"].alias(out)).union(none)


def combine_scores(df: DataFrame, isolation: str, neighbours: str, centroid: str) -> DataFrame:
    """Raw scores scaled to 0..1, their mean over those present, and why a row stands out. df is written first, so that what the ranges read isn't computed again for the rows."""
    df = min_max_all(settled(df, "scores"), {isolation: "outlier_quality_isolation", neighbours: "outlier_embedding_nn", centroid: "outlier_class_centroid"})
    parts = [F.col(c) for c in ("outlier_quality_isolation", "outlier_embedding_nn", "outlier_class_centroid")]
    return df.withColumn("outlier_score", mean_of_present(*parts)).withColumn("outlier_reason", outlier_reason(*parts))


def vectors_from(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        flat = batch.column(column)
        yield batch, flat.flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
