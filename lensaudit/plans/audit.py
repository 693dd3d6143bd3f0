"""The whole audit of an image dataset: one keyed table, each image decoded once, small results rendered by the driver.

Each stage takes and gives DataFrames keyed by row_index. The measured images are written once as Parquet (the spine) and all later
stages read that; what a stage hands the driver is a table of classes, metrics or top rows.
"""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QUALITY_METRICS, AuditConfig
from ..functions import columns as C
from ..functions import kernels
from ..operators import duplicates, isolation, projection, relational, umap, vectors
from ..report import charts, drawings
from ..report.markdown import Section, report
from ..shipping import ship_code
from ..sources import files, images, records
from ..sources.decoders import Decoder

SIZES = ("width", "height", "aspect_ratio", "file_size_bytes")
SCORES = ("outlier_quality_isolation", "outlier_embedding_nn", "outlier_class_centroid", "outlier_score", "outlier_reason")
#: Points of a scatter chart up to which each row is one; cells across and down in which more rows are counted.
POINTS, CELLS = 5000, (120, 80)
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
COLOURS = ("label", "brightness", "blur_score", "analysis_domain", "source_domain")


class Outputs:
    """Files of a run, in a folder or below a URI: CSV by Spark, as one ordered file or (folders) as one in ordered parts, text and pictures (montages by `decoder`) by the driver."""

    def __init__(self, spark: SparkSession, folder: str, folders: bool = False, decoder: Decoder | None = None):
        self.spark, self.folder, self.folders, self.decoder = spark, folder.rstrip("/"), folders, decoder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def text(self, name: str, text: str) -> None:
        files.write(self.spark, self.path(name), text.encode())

    def data(self, name: str, data: bytes | None) -> None:
        if data is not None:
            files.write(self.spark, self.path(name), data)

    def chart(self, name: str, drawing: drawings.Drawing) -> None:
        """As name.svg and name.png."""
        self.text(f"{name}.svg", drawing.svg())
        self.data(f"{name}.png", drawing.png())

    def csv(self, name: str, df: DataFrame) -> None:
        """With header, rows in df's order; arrays are left out. Many tasks write; as one file their parts are joined in that order below one header."""
        flat = df.select(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("array", "binary"))])
        part = self.path(name if self.folders else name + ".parts")
        flat.write.mode("overwrite").option("header", self.folders).option("escape", '"').csv(files.uri(part))
        if not self.folders:
            head = self.spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(flat.columns)]), {"escape": '"'})).first()[0]
            files.join_parts(self.spark, part, self.path(name), f"{head}\n".encode())

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Parquet, written and read again: what later stages start from."""
        at = files.uri(self.path(name))
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)


def _named(spark: SparkSession, rows: DataFrame, decoder: Decoder | None) -> tuple[DataFrame, DataFrame]:
    """Sizes and pictures of the files that rows name, opened one by one: no other file is touched."""
    listed = images.list_named(rows)
    return listed, images.contents_named(rows) if decoder else images.decode_named(spark, listed)


def _by_folder(spark: SparkSession, rows: DataFrame, decoder: Decoder | None) -> tuple[DataFrame, DataFrame]:
    """The same for stores that only Spark's sources can open: the files' folders are listed, and all files in them are read."""
    parents = rows.select(F.regexp_replace("image_path", "/[^/]*$", "").alias("p")).distinct()
    roots = [r["p"] for r in parents.toLocalIterator() if r["p"] and files.exists(spark, r["p"], folder=True)]
    if not roots:
        kind = "content binary" if decoder else "height int, width int, nChannels int, data binary"
        return spark.createDataFrame([], "image_path string, file_size_bytes bigint"), spark.createDataFrame([], f"image_path string, {kind}")
    where = (spark, roots, False, True)
    pictures = (images.contents if decoder else images.decode)(*where)
    return images.list_files(*where), pictures.join(rows.select("image_path").distinct(), "image_path", "left_semi")


def ingest(spark: SparkSession, config: AuditConfig, embed: images.Embedder | None = kernels.grid_embedding, decoder: Decoder | None = None) -> DataFrame:
    """The spine: a row for each listed image, readable or not, with measures and domains, numbered in path or file order.

    A manifest may name files of any suffix; only the files it names, or the first max_images of a folder, are opened. Images are decoded by the JVM, or from their bytes by `decoder`.
    """
    cwd = os.getcwd()
    if config.csv_path:
        manifest = records.read_manifest(spark, config.csv_path)
        rows = records.csv_records(manifest, config.image_column, config.label_column, config.source_column, config.path_root, cwd, config.max_images)
        if images.named_by_tasks(rows):
            listed, pictures = _named(spark, rows, decoder)
        else:
            listed, pictures = _by_folder(spark, rows, decoder)
    else:
        where = (spark, [config.dataset_root], config.recursive)
        listed = images.list_files(*where)
        rows = records.folder_records(listed, config.dataset_root, config.max_images)
        if config.max_images and images.named_by_tasks(rows):
            pictures = _named(spark, rows, decoder)[1]
        else:
            pictures = (images.contents if decoder else images.decode)(*where)
            if config.max_images:
                pictures = pictures.join(rows.select("image_path").distinct(), "image_path", "left_semi")
    spine = records.with_row_index(rows)
    measured = images.measure(pictures, embed, decoder, config.measures)
    given = [c for c in spine.columns if c in measured.columns and c != "image_path"]
    doubles = [c for c, kind in measured.dtypes if kind == "double"]
    spine = spine.withColumnsRenamed({c: f"_given_{c}" for c in given}).join(listed, "image_path", "left").join(measured, "image_path", "left")
    for c in given:  # values of the manifest count where an image gives none
        spine = spine.withColumn(c, F.coalesce(C.no_nan(F.col(c)) if c in doubles else F.col(c), F.expr(f"try_cast(`_given_{c}` AS {measured.schema[c].dataType.simpleString()})"))).drop(f"_given_{c}")
    spine = spine.withColumns({
        "is_readable": F.coalesce("is_readable", F.lit(False)), "load_error": F.when(F.col("is_readable").isNull(), F.coalesce("load_error", F.lit("no such file"))).otherwise(F.col("load_error")),
        "aspect_ratio": C.aspect_ratio(F.col("width"), F.col("height")), "resolution_bucket": C.resolution_bucket(F.col("width"), F.col("height")),
        "filename": C.file_name(F.col("image_path")), "ahash": C.hash_hex(F.col("ahash_bits")), "dhash": C.hash_hex(F.col("dhash_bits")),
    })
    return relational.infer_domain(spine, "source_domain", "resolution_bucket")


def unreadable(spine: DataFrame) -> DataFrame:
    return spine.where(~F.col("is_readable")).select("image_path", "label", F.col("load_error").alias("error")).orderBy("image_path")


def _first(df: DataFrame, n: int) -> list:
    return df.limit(n).collect()


def _pixels(spark: SparkSession, paths: list[str], decoder: Decoder | None) -> dict[str, np.ndarray]:
    """Decoded pictures for a montage: of at most some fifty files."""
    found = [images.literal(p) for p in dict.fromkeys(paths) if files.exists(spark, p)]
    if not found:
        return {}
    if decoder:
        got = spark.read.format("binaryFile").load(found).select(images.plain_path(F.col("path")).alias("p"), "content").collect()
        return {r["p"]: decoder(bytes(r["content"])) for r in got}
    got = spark.read.format("image").option("dropInvalid", "true").load(found)
    rows = got.select(images.plain_path(F.col("image.origin")).alias("p"), "image.height", "image.width", "image.nChannels", "image.data").collect()
    return {r["p"]: images.pixels(r["height"], r["width"], r["nChannels"], bytes(r["data"])) for r in rows}


def _montage(spark, out: Outputs, name: str, paths: list[str], config: AuditConfig, columns: int | None = None) -> None:
    seen = _pixels(spark, paths, out.decoder)
    out.data(name, charts.montage([seen.get(p) for p in paths], config.montage_tile, columns or config.montage_columns))


def summarise(spine: DataFrame, config: AuditConfig, out: Outputs, ingestion: Section) -> Section:
    readable = spine.where("is_readable")
    per = relational.counts(readable, "label")
    doubles = relational.repeated_keys(readable, "filename")
    out.csv("class_counts.csv", per)
    out.csv("image_size_summary.csv", relational.describe(readable, SIZES))
    out.csv("duplicate_filenames.csv", doubles)
    rows = [tuple(r) for r in per.collect()]
    out.chart("class_counts", drawings.bars("Images per class", rows))
    out.chart("image_size_distributions", drawings.histogram_panels("Image sizes", [(c, _bins(readable, c)) for c in SIZES[:3]]))
    n = relational.totals(spine, "label", F.col("is_readable")).first()
    facts = [("images listed", n["n_rows"]), ("decoded", n["n_readable"]), ("not decoded", n["n_unreadable"]), ("labels among the decoded", n["n_classes"]), ("file names that occur again", doubles.count())]
    section = Section("What the dataset holds", facts, [("Decoded images by label", ("label", "images"), rows)])
    out.text("dataset_summary.md", ingestion.markdown() + "\n" + section.markdown())
    return section


def _bins(df: DataFrame, column: str) -> list[tuple]:
    return [(r["lo"], r["hi"], r["n"]) for r in relational.histogram(df, column).orderBy("bin").collect()]


def assess_quality(spine: DataFrame, config: AuditConfig, out: Outputs) -> Section:
    spark, k = spine.sparkSession, config.extremes_k
    for m in config.quality_metrics:
        if bins := _bins(spine, m):
            out.chart(f"quality/{m}_hist", drawings.histogram_panels(m, [(m, bins)]))
            out.chart(f"quality/{m}_by_class", drawings.boxes(m, [tuple(r[c] for c in ("label", "q1", "median", "q3", "whisker_low", "whisker_high")) for r in relational.boxplot(spine, "label", m).collect()]))
        for name, lowest in (("lowest", True), ("highest", False)):
            table = relational.extremes(spine.where(F.col("label").isNotNull()), m, k, "row_index", lowest, ["image_path", "label"]).drop("row_index")
            out.csv(f"quality/{m}_{name}.csv", table)
            shown = [r["image_path"] for r in relational.extremes(spine, m, k, "row_index", lowest, ["image_path"]).collect()]
            _montage(spark, out, f"quality/{m}_{name}_montage.png", shown, config)
    summary = relational.describe(spine, config.quality_metrics)
    out.csv("quality/quality_metric_summary.csv", summary.select("statistic", *[F.bround(m, 3).alias(m) for m in config.quality_metrics]))
    r = relational.correlation(spine, config.quality_metrics)
    out.csv("quality/quality_metric_correlation.csv", r)
    out.chart("quality/quality_metric_correlation", drawings.heat_map("How the measures move together", config.quality_metrics, {(x["x"], x["y"]): x["r"] for x in r.collect()}))
    section = Section("Image measures", [("measures", ", ".join(config.quality_metrics)), ("charts, extremes and montages", f"`{out.path('quality')}`")])
    out.text("quality/quality_summary.md", section.markdown())
    return section


def assess_bias(spine: DataFrame, config: AuditConfig, out: Outputs) -> Section:
    readable = spine.where("is_readable")
    balance = relational.class_balance(readable, "label")
    out.csv("bias_class_balance.csv", balance)
    by_class = relational.effects(readable, "label", config.quality_metrics, "label", config.effect_threshold, config.effect_rows)
    out.csv("bias_quality_effects_by_class.csv", by_class)
    tables = [by_class]
    if readable.agg(F.count_distinct("analysis_domain")).first()[0] > 1:
        tables.append(relational.effects(readable, "analysis_domain", config.quality_metrics, "analysis_domain", config.effect_threshold, config.effect_rows))
        out.csv("bias_quality_effects_by_domain.csv", tables[1])
    kind = readable.select("analysis_domain_kind").first()
    if kind:
        out.csv("label_by_analysis_domain.csv", relational.contingency_wide(readable, "label", "analysis_domain"))
    flagged = relational.suspicious(tables)
    out.csv("suspicious_shortcut_signals.csv", flagged)
    n = balance.agg(F.min("count"), F.max("count")).first()
    facts = [("rows of the smallest label", n[0]), ("rows of the largest label", n[1]), ("effects that are large enough to serve as a shortcut", flagged.count()), ("where domains come from", kind[0] if kind else "there are none")]
    lines = [f"`{r['metric']}` of {r['group_type']} `{r['group_name']}`: {r['cohens_d_vs_rest']:.2f} pooled deviations from all other rows" for r in _first(flagged, config.report_rows)]
    section = Section("Labels, domains and shortcuts", facts, lines=lines)
    out.text("bias_analysis.md", section.markdown())
    return section


def find_duplicates(spine: DataFrame, config: AuditConfig, out: Outputs) -> Section:
    exact = duplicates.exact_groups(spine.where("is_readable"), "ahash", ["row_index", "image_path", "label"]).orderBy("cluster_id", "row_index").select("cluster_id", "ahash", "image_path", "label")
    near = duplicates.near_pairs(spine.where("is_readable"), "row_index", "ahash_bits", "dhash_bits", ["image_path", "label"], config.hamming_threshold)
    near = near.orderBy("ahash_distance", "dhash_distance", "left_label", "right_label", "left_index", "right_index")
    out.csv("exact_hash_match_groups.csv", exact)
    out.csv("near_duplicate_pairs.csv", near)
    top = _first(near, config.duplicate_k)
    _montage(spine.sparkSession, out, "near_duplicate_pairs_montage.png", [r[c] for r in top for c in ("left_image_path", "right_image_path")], config, 2)
    facts = [("groups with one average hash", exact.select("cluster_id").distinct().count()), ("near pairs", near.count()), ("bits that each hash of a pair may differ in", config.hamming_threshold)]
    lines = [f"`{Path(r['left_image_path']).name}`, `{Path(r['right_image_path']).name}`: {r['ahash_distance']} bits apart by average, {r['dhash_distance']} by difference hash" for r in top[: config.report_rows]]
    section = Section("Repeated images", facts, lines=lines)
    out.text("duplicate_detection.md", section.markdown())
    return section


def _points(spine: DataFrame, x: str, y: str, colour: str) -> tuple[list[tuple], int]:
    """What a chart shows of all rows with coordinates and colour, and how many they are.

    Up to POINTS rows: (x, y, colour). More: a bin for each cell and name, or each cell where colours are numbers: (mean x, mean y, name or mean, rows).
    """
    rows = spine.where(F.col(colour).isNotNull() & F.col(x).isNotNull())
    some = rows.select(x, y, colour, "row_index").limit(POINTS + 1)
    if some.count() <= POINTS:
        found = [tuple(r)[:3] for r in some.orderBy(F.xxhash64("row_index")).collect()]
        return found, len(found)
    edge = rows.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate((x, y)) for f in (F.min, F.max)]).first()
    cell = [F.least(F.floor((F.col(c) - edge[f"min{i}"]) / ((edge[f"max{i}"] - edge[f"min{i}"]) or 1.0) * CELLS[i]), F.lit(CELLS[i] - 1)).alias(f"_cell{i}") for i, c in enumerate((x, y))]
    number = spine.schema[colour].dataType.typeName() == "double"
    shown = F.avg(colour).alias("_shown") if number else F.first(colour).alias("_shown")
    bins = rows.groupBy(*cell, *([] if number else [F.col(colour).alias("_name")])).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"), shown, F.count("*").alias("_n"))
    found = [tuple(r) for r in bins.orderBy(F.xxhash64("_cell0", "_cell1", "_shown")).select("_x", "_y", "_shown", "_n").collect()]
    return found, sum(r[3] for r in found)


def embed_and_project(spine: DataFrame, config: AuditConfig, out: Outputs, status: str) -> tuple[DataFrame, Section]:
    n = spine.where("embedding IS NOT NULL").count()
    second, shown = config.projection, {"tsne": "t-SNE", "umap": "UMAP"}[config.projection]
    names = [f"{p}_{a}" for p in ("pca", second) for a in "xy"]
    if not n:
        return spine.withColumns({c: F.lit(None).cast("double") for c in names}), Section("Vectors and projections", remark="No row has a vector.")
    laid = umap.umap(spine, "row_index", "embedding", config.seed) if second == "umap" else projection.tsne(spine, "row_index", "embedding", config.seed)
    at = projection.pca(spine, "row_index", "embedding").join(laid, "row_index")
    spine = spine.join(at, "row_index", "left")
    for p in ("pca", second) if n >= 5 else ("pca",):
        for colour in COLOURS:
            rows, held = _points(spine, f"{p}_x", f"{p}_y", colour)
            if rows:
                title = f"{p.upper()} coloured by {colour}" + (f": {held} rows in {len(rows)} bins" if held > len(rows) else "")
                out.chart(f"embeddings/{p}_by_{colour}", drawings.scatter(title, rows))
    size = spine.where("embedding IS NOT NULL").select(F.size("embedding")).first()[0]
    cells = [F.get("embedding", F.lit(i)).alias(f"embedding_{i:03d}") for i in range(size)]
    given = [c for c in spine.columns if (c.startswith("embedding_") or c.endswith(("_x", "_y"))) and c not in (*names, *(f"embedding_{i:03d}" for i in range(size)))]
    out.csv("embeddings/embedding_table.csv", spine.orderBy("row_index").select("image_path", "label", "source_domain", "analysis_domain", "analysis_domain_kind", *[F.col(f"`{c}`") for c in given], *cells, *names))
    section = Section("Vectors and projections", [("made by", status), ("rows with a vector", n), ("projections drawn", f"PCA and {shown}" if n >= 5 else "PCA"), ("charts and table", f"`{out.path('embeddings')}`")])
    out.text("embeddings/embedding_summary.md", section.markdown())
    return spine, section


def find_outliers(spine: DataFrame, config: AuditConfig, out: Outputs) -> tuple[DataFrame, Section]:
    candidates = spine.dropna(subset=list(config.quality_metrics))
    n = candidates.count()
    if not n:
        empty = {c: F.lit(None).cast("string" if c == "outlier_reason" else "double") for c in SCORES}
        return spine.withColumns(empty), Section("Rows that stand out", remark="No row has all measures, so none is scored.")
    base = candidates.select("row_index", "label", "embedding")
    forest = isolation.isolation_scores(relational.standardise(candidates.select("row_index", *config.quality_metrics), config.quality_metrics), "row_index", config.quality_metrics, seed=config.seed)
    if candidates.where("embedding IS NOT NULL").take(1):
        raw = vectors.centroid_distance(base, "label", "embedding").join(vectors.knn_distance(base, "row_index", "embedding"), "row_index", "left")
    else:
        raw = base.withColumns({"centroid_distance": F.lit(0.0), "knn_distance": F.lit(0.0)})
    scored = vectors.combine_scores(raw.drop("label", "embedding").join(forest, "row_index", "left"), "isolation", "knn_distance", "centroid_distance").select("row_index", *SCORES)
    full = spine.join(out.table("scores.parquet", scored), "row_index", "left")
    ranked = full.where("outlier_score IS NOT NULL").orderBy(F.desc("outlier_score"), "row_index")
    out.csv("outlier_scores.csv", ranked)
    out.csv("top_suspicious_samples.csv", ranked.limit(config.outlier_k))
    top = _first(ranked.select("image_path", "outlier_score", "outlier_reason"), config.outlier_k)
    _montage(spine.sparkSession, out, "top_suspicious_samples_montage.png", [r["image_path"] for r in top], config)
    lines = [f"`{Path(r['image_path']).name}` ({r['outlier_score']:.2f}): {r['outlier_reason']}" for r in top[: config.report_rows]]
    section = Section("Rows that stand out", [("rows scored", n), ("rows in `top_suspicious_samples.csv`", len(top))], lines=lines, remark="The mean of up to three scores between 0 and 1. A high one says that a row differs from others, not why.")
    out.text("outlier_summary.md", section.markdown())
    return full, section


MULTI_VIEW = Section("Views of one object", remark="Each image is judged by itself. Manifest columns that name the object and the view would be passed through to all tables, but nothing joins rows by them.")


def run_audit(spark: SparkSession, config: AuditConfig, embed: images.Embedder | None = kernels.grid_embedding, embed_status: str = "grid statistics, no model", decoder: Decoder | None = None) -> DataFrame:
    """All stages and their files; returns the final spine."""
    config.validate()
    ship_code(spark)
    out = Outputs(spark, config.output_dir, config.csv_folders, decoder)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, config.batch_size)
    try:
        spine = out.table("spine.parquet", ingest(spark, config, embed, decoder))
    finally:
        spark.conf.set(BATCH, before)
    ordered = lambda df: df.orderBy("row_index").drop("row_index")
    base = [c for c in spine.columns if c not in (*QUALITY_METRICS, *config.quality_metrics, "ahash", "dhash", "ahash_bits", "dhash_bits", "embedding")]
    out.csv("dataset_manifest.csv", ordered(spine.select(*base)))
    out.csv("corrupted_or_unreadable_images.csv", unreadable(spine))
    n = relational.totals(spine, "label", F.col("is_readable")).first()
    kind = spine.select("analysis_domain_kind").first()
    facts = [("source", f"manifest `{config.csv_path}`" if config.csv_path else f"folder `{config.dataset_root}`"), ("rows", n["n_rows"]), ("rows in `corrupted_or_unreadable_images.csv`", n["n_unreadable"]), ("where domains come from", kind[0] if kind else "there are none")]
    ingestion = Section("Input", facts)
    sections = [ingestion, summarise(spine, config, out, ingestion), assess_quality(spine, config, out)]
    out.csv("dataset_manifest_with_quality.csv", ordered(spine.select(*base, *config.quality_metrics)))
    sections += [assess_bias(spine, config, out), find_duplicates(spine, config, out)]
    spine, section = embed_and_project(spine, config, out, embed_status)
    sections.append(section)
    out.csv("dataset_manifest_with_embeddings.csv", ordered(spine.drop("ahash_bits", "dhash_bits")))
    spine, section = find_outliers(spine, config, out)
    sections.append(section)
    out.csv("dataset_manifest_final.csv", ordered(spine.drop("ahash_bits", "dhash_bits")))
    out.text("multiview_placeholder.md", MULTI_VIEW.markdown())
    sections.append(MULTI_VIEW)
    configuration = {"dataset_root": config.dataset_root, "csv_path": config.csv_path, "output_dir": config.output_dir, "max_images": config.max_images}
    out.text("final_report.md", report(config.report_title, configuration, sections))
    return spine
