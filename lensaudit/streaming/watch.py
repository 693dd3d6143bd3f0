"""Measures new images of a folder as they arrive: the same pass over pixels as a batch audit, with Structured Streaming's exactly-once files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..functions import kernels
from ..shipping import ship_code
from ..sources import images

_IMAGE = T.StructType([T.StructField("image", T.StructType([
    T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType()),
]))])


def arriving(spark: SparkSession, root: str, files_a_batch: int = 1000, embed: images.Embedder | None = kernels.grid_embedding) -> DataFrame:
    """A streaming frame of measured images with label, domain and hashes; files that can't be decoded come as unreadable rows."""
    ship_code(spark)
    stream = (
        spark.readStream.format("image").schema(_IMAGE).option("dropInvalid", "false").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", images.any_case()).option("maxFilesPerTrigger", files_a_batch).load(images.literal(root))
    )
    decoded = stream.select(images.plain_path(F.col("image.origin")).alias("image_path"), "image.height", "image.width", "image.nChannels", "image.data")
    measured = images.measure(decoded, embed)
    relative = F.substring("image_path", len(root.rstrip("/")) + 2, 1 << 20)
    return measured.withColumns({
        "label": C.folder_label(relative), "source_domain": C.folder_domain(relative), "filename": C.file_name(F.col("image_path")),
        "aspect_ratio": C.aspect_ratio(F.col("width"), F.col("height")), "resolution_bucket": C.resolution_bucket(F.col("width"), F.col("height")),
        "ahash": C.hash_hex(F.col("ahash_bits")), "dhash": C.hash_hex(F.col("dhash_bits")),
    })


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Appends measured images to the Parquet folder out; once: takes what is there and stops."""
    writer = arriving(spark, root).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
