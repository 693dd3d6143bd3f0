"""Rows of a dataset before their images are looked at: from folders, from a CSV manifest, from annotation lists."""

from __future__ import annotations

import os.path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.relational import membership
from ..scratch import settled
from .files import exists, normal, uri


#: Bits of a monotonically increasing id that count within a partition.
_PLACE = (1 << 33) - 1


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Numbers rows from 0 in the order of df: its partitions one after the other, as an orderBy() leaves them.

    Each row is written with its partition and its place in it; rows are then counted by partition, and what a row's partition has before it is added to its place.
    Only these counts, a row a partition, are summed up in one task and sent to all. A sort isn't done twice, as two runs may cut its ranges at other rows or put ties in
    another order: numbers come from the written table, whatever tasks are lost later. Columns may have any names, but for that of the number; an empty table stays empty.
    """
    placed = settled(df.select(F.struct("*").alias("_row"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("_at")), "rows")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_at")).alias(name), *[F.col(f"_row.`{c}`") for c in df.columns])


def folder_records(files: DataFrame, root: str, max_images: int | None = None) -> DataFrame:
    """(image_path, label, source_domain) of files below root, ordered folder by folder; the first max_images (0: all)."""
    relative = F.substring(F.col("image_path"), len(root.rstrip("/")) + 2, 1 << 20)
    rows = files.select("image_path", C.folder_label(relative).alias("label"), C.folder_domain(relative).alias("source_domain"))
    rows = rows.orderBy(F.split("image_path", "/"))
    return rows.limit(max_images) if max_images else rows


def _normal(path: pd.Series) -> pd.Series:
    return path.map(lambda p: normal(p) if p else p)


def resolved_path(raw, root: str | None, cwd: str):
    """Absolute paths and URIs as they are, `~` expanded, others below root or the working directory; `..` and links resolved."""
    raw = F.regexp_replace(raw, "^~(?=/|$)", os.path.expanduser("~"))
    return F.pandas_udf(_normal, "string")(F.when(raw.startswith("/") | raw.contains("://"), F.regexp_replace(raw, "^file:/+", "/")).otherwise(F.concat(F.lit((root or cwd).rstrip("/") + "/"), raw)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header in file order, missing-value tokens as nulls, types inferred after that."""
    text = spark.read.csv(uri(path), header=True, inferSchema=False, escape='"', multiLine=True)
    text = text.select(*[C.missing_to_null(F.col(f"`{c}`")).alias(c) for c in text.columns])
    kinds = {}
    checks = [F.struct(*[F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | F.expr(f"try_cast(`{c}` AS {k})").isNotNull()), F.lit(True)).alias(k) for k in ("bigint", "double")], F.count(F.col(f"`{c}`")).alias("n")).alias(str(i)) for i, c in enumerate(text.columns)]
    found = text.agg(*checks).first()
    for i, c in enumerate(text.columns):
        kinds[c] = next((k for k in ("bigint", "double") if found[i][k] and found[i]["n"]), "string")
    return text.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in text.columns])


def csv_records(manifest: DataFrame, image_column: str, label_column: str, source_column: str | None, path_root: str | None, cwd: str, max_images: int | None = None) -> DataFrame:
    """The manifest with image_path, label and source_domain; all other columns pass through."""
    missing = [c for c in (image_column, label_column) if c not in manifest.columns]
    if missing:
        raise ValueError(f"the manifest lacks the columns {', '.join(missing)}")
    if max_images:
        manifest = manifest.limit(max_images)
    out = manifest.withColumn("label", F.col(label_column).cast("string")).withColumn("image_path", resolved_path(F.col(image_column).cast("string"), path_root, cwd))
    if source_column and source_column in manifest.columns:
        out = out.withColumn("source_domain", F.col(source_column).cast("string"))
    elif "source_domain" not in manifest.columns:
        out = out.withColumn("source_domain", F.lit(None).cast("string"))
    return out


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first token of each line of an id list, distinct; nothing if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "image_id string")
    lines = spark.read.text(uri(path)).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.split(F.trim("value"), r"\s+")[0].alias("image_id")).distinct()


def pets_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The annotation list of a pets dataset as a manifest, in the order of its lines. Lines without exactly four fields raise."""
    at = os.path.join(root, "annotations")
    if not exists(spark, os.path.join(at, "list.txt")):
        raise FileNotFoundError(os.path.join(at, "list.txt"))
    lines = spark.read.text(uri(os.path.join(at, "list.txt"))).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    f = F.when(F.size(f) == 4, f).otherwise(F.raise_error(F.concat(F.lit("expected four fields: "), F.col("value"))))
    rows = with_row_index(lines.select(f.alias("f")).select(F.col("f")[0].alias("image_id"), F.col("f")[1].alias("class"), F.col("f")[2].alias("kind"), F.col("f")[3].alias("breed")))
    flagged = membership(rows, "image_id", {"is_trainval": split_ids(spark, os.path.join(at, "trainval.txt")), "is_test": split_ids(spark, os.path.join(at, "test.txt"))})
    return flagged.orderBy("row_index").select(
        "image_id", F.concat(F.col("image_id"), F.lit(".jpg")).alias("image_path"), C.breed(F.col("image_id")).alias("label"),
        F.col("class").cast("int").alias("class_id"), C.species(F.col("kind")).alias("species"), F.col("breed").cast("int").alias("breed_id"),
        C.split_name(F.col("is_trainval"), F.col("is_test")).alias("split"), "is_trainval", "is_test",
    )
