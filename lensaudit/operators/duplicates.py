"""Exact groups and near pairs of perceptual hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hamming
from .relational import distinct_rank


def exact_groups(df: DataFrame, hash_hex: str, columns: Sequence[str]) -> DataFrame:
    """(cluster_id, hash, columns) for rows whose hash another row has too; clusters are numbered by the hash's hex."""
    shared = df.where(F.col(hash_hex).isNotNull()).groupBy(F.col(hash_hex).alias("_hash")).agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    ranked = distinct_rank(shared, "_hash", "_rank")
    rows = df.select(F.col(hash_hex).alias("_of"), F.struct(*columns).alias("_row"))
    return rows.join(ranked, F.col("_of") == F.col("_hash")).select(F.col("_rank").alias("cluster_id"), F.col("_of").alias(hash_hex), "_row.*")


def near_pairs(df: DataFrame, index: str, ahash: str, dhash: str, columns: Sequence[str] = (), threshold: int = 6, prefix_bits: int = 16) -> DataFrame:
    """(left_*, right_*, ahash_distance, dhash_distance) of rows whose hashes (64-bit integers) differ in few bits, left index first.

    Candidates share the first bits of the average hash and, as so few bits differ, one of threshold + 1 pieces of the difference hash: an equi-join, in which
    a pair counts where its first equal piece is. Rows with equal hashes meet as one until the end, so a flat image
    that thousands of rows show costs one comparison for each other hash of its bucket. prefix_bits=0 compares all: exhaustive, and quadratic.
    """
    rows = df.where(F.col(ahash).isNotNull() & F.col(dhash).isNotNull()).select(F.col(index).alias("_i"), F.col(ahash).alias("_a"), F.col(dhash).alias("_d"), *columns)
    bits = [64 * i // (threshold + 1) for i in range(threshold + 2)]
    pieces = F.array(*[F.shiftrightunsigned("_d", 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(bits, bits[1:], strict=False)])
    bucket = F.shiftrightunsigned("_a", 64 - prefix_bits) if prefix_bits else F.lit(0).cast("bigint")
    kinds = rows.select("_a", "_d").distinct().withColumns({"_b": bucket, "_p": pieces})
    kind = lambda s: kinds.select(F.col("_a").alias(f"_{s}a"), F.col("_d").alias(f"_{s}d"), F.col("_p").alias(f"_{s}p"), "_b", F.posexplode("_p").alias("_at", "_piece"))
    near = kind("l").join(kind("r"), ["_b", "_at", "_piece"]).where(F.array_position(F.zip_with("_lp", "_rp", lambda x, y: x == y), True) == F.col("_at") + 1)
    near = near.withColumn("ahash_distance", hamming(F.col("_la"), F.col("_ra"))).withColumn("dhash_distance", hamming(F.col("_ld"), F.col("_rd")))
    near = near.where((F.col("ahash_distance") <= threshold) & (F.col("dhash_distance") <= threshold)).select("_la", "_ld", "_ra", "_rd", "ahash_distance", "dhash_distance")
    side = lambda s, t: rows.select(F.col("_i").alias(f"{s}_index"), F.col("_a").alias(f"_{t}a"), F.col("_d").alias(f"_{t}d"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    pairs = near.join(side("left", "l"), ["_la", "_ld"]).join(side("right", "r"), ["_ra", "_rd"]).where("left_index < right_index")
    return pairs.select("left_index", "right_index", *[f"{s}_{c}" for c in columns for s in ("left", "right")], "ahash_distance", "dhash_distance")
