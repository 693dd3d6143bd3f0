"""Images by Spark's own sources: every file is decoded once, in the JVM, and measured in one Arrow pass."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS, QUALITY_METRICS, Measure
from ..functions import kernels
from ..functions.models import Batched
from .decoders import Decoder
from .files import is_uri, opened, reachable, sizes

#: Pixels to an embedding, image by image, or a model that takes them in batches. A model is loaded where it is first called, once a worker.
Embedder = Callable[[np.ndarray], np.ndarray] | Batched


def any_case(extensions=EXTENSIONS) -> str:
    """A glob for the suffixes in any case."""
    one = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))
    return "*.{" + ",".join(map(one, extensions)) + "}"


def plain_path(uri: Column) -> Column:
    """An absolute path from a path that the sources give, with or without scheme and escapes."""
    bare = F.regexp_replace(uri, "^file:/+", "/")
    return F.when(uri.startswith("file:///"), F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).otherwise(bare)


def literal(path: str) -> str:
    """A path for load() that means itself, whatever it holds of a glob's signs."""
    return ("" if is_uri(path) else "file://") + re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _load(spark: SparkSession, kind: str, roots: list[str], recursive: bool, any_suffix: bool, given: bool = False) -> DataFrame:
    """given: roots are paths of load() already."""
    reader = spark.read.format(kind).option("recursiveFileLookup", str(recursive).lower())
    if kind == "image":
        reader = reader.option("dropInvalid", "false")
    return (reader if any_suffix else reader.option("pathGlobFilter", any_case())).load(roots if given else [literal(r) for r in roots])


def list_files(spark: SparkSession, roots: list[str], recursive: bool = True, any_suffix: bool = False) -> DataFrame:
    """(image_path, file_size_bytes); contents aren't read. Hidden files are passed over. any_suffix: files that a manifest may name, whatever they are called."""
    files = _load(spark, "binaryFile", roots, recursive, any_suffix)
    return files.select(plain_path(F.col("path")).alias("image_path"), F.col("length").alias("file_size_bytes"))


def decode(spark: SparkSession, roots: list[str], recursive: bool = True, any_suffix: bool = False, given: bool = False) -> DataFrame:
    """(image_path, height, width, nChannels, data) by the JVM; files that can't be decoded have a height of -1."""
    images = _load(spark, "image", roots, recursive, any_suffix, given)
    return images.select(plain_path(F.col("image.origin")).alias("image_path"), "image.height", "image.width", "image.nChannels", "image.data")


def contents(spark: SparkSession, roots: list[str], recursive: bool = True, any_suffix: bool = False) -> DataFrame:
    """(image_path, content): bytes as they are, for measure() with a decoder of one's own."""
    files = _load(spark, "binaryFile", roots, recursive, any_suffix)
    return files.select(plain_path(F.col("path")).alias("image_path"), "content")


#: Files that a task is given to open, about; what it holds of them before it hands them on.
FILES_A_TASK, HELD_FILES, HELD_BYTES = 256, 32, 16 << 20


def _dealt(paths: DataFrame) -> DataFrame:
    """Distinct image_path, in so many partitions that each has FILES_A_TASK or so."""
    once = paths.select("image_path").where("image_path IS NOT NULL").distinct()
    return once.repartition(max(1, -(-once.count() // FILES_A_TASK)), "image_path")


def _open(with_contents: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.binary() if with_contents else pa.int64()]
        names = ["image_path", "content" if with_contents else "file_size_bytes"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            paths, held, total = batch.column(0).to_pylist(), [], 0
            for path, size in zip(paths, sizes(paths), strict=True):
                if size is None:
                    continue
                held.append((path, opened(path) if with_contents else size))
                total += size
                if len(held) >= HELD_FILES or (with_contents and total >= HELD_BYTES):
                    yield out(held)
                    held, total = [], 0
            if held:
                yield out(held)

    return run


def list_named(paths: DataFrame) -> DataFrame:
    """list_files() for the files that a table (image_path) names: tasks look each up by itself, no folder is listed and no path reaches the driver.

    Files that don't exist have no row; so have folders. Repeated paths have one row, null paths none.
    """
    return _dealt(paths).mapInArrow(_open(False), "image_path string, file_size_bytes bigint")


def contents_named(paths: DataFrame) -> DataFrame:
    """contents() for the files that a table (image_path) names: a partition is a batch of paths, whose files its task opens one after the other, and no others."""
    return _dealt(paths).mapInArrow(_open(True), "image_path string, content binary")


def decode_named(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """decode() for the files of list_named(): the JVM's source is given the paths themselves, so it lists and decodes no other file.

    That source keeps what it reads as a list on the driver, whether given paths or a folder; contents_named() with a decoder doesn't.
    """
    paths = [literal(r["image_path"]) for r in listed.select("image_path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "image_path string, height int, width int, nChannels int, data binary")
    return decode(spark, paths, recursive=False, any_suffix=True, given=True)


def named_by_tasks(paths: DataFrame) -> bool:
    """Whether tasks can open all files of a table (image_path) by themselves: local or mounted paths, and URIs of stores that Arrow knows."""
    schemes = paths.select(F.regexp_extract("image_path", "^([a-zA-Z0-9+.-]+)://", 1).alias("s")).where("image_path IS NOT NULL").distinct()
    return all(reachable(r["s"]) for r in schemes.collect())


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB from the source's BGR, gray or BGRA bytes."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, 2) if channels == 1 else x[..., 2::-1]


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64(), "array<float>": pa.list_(pa.float32())}
#: Rows that wait for a batch to fill, at most; pixels' bytes that wait to be measured together, about.
WAITING, STACKED = 4096, 1 << 19


def measured_columns(extra: Sequence[Measure] = ()) -> list[tuple[str, str]]:
    """Names and types of what measure() gives."""
    own = [("image_path", "string"), ("width", "int"), ("height", "int"), ("is_readable", "boolean"), ("load_error", "string"), *((m, "double") for m in QUALITY_METRICS)]
    return [*own, *((m.name, m.kind) for m in extra), ("ahash_bits", "bigint"), ("dhash_bits", "bigint"), ("embedding", "array<float>")]


def _pictures(batch: pa.RecordBatch, decoder: Decoder | None) -> Iterator[tuple[str, np.ndarray | None, str]]:
    """Path, pixels or None, and why there are none."""
    if decoder is None:
        for path, height, width, channels, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            yield path, pixels(height, width, channels, data.as_buffer()) if (height or -1) > 0 else None, "cannot identify image file"
        return
    for path, content in zip(batch.column(0), batch.column(1), strict=True):
        try:
            yield path.as_py(), decoder(content.as_py()), ""
        except (OSError, ValueError) as e:
            yield path.as_py(), None, str(e) or type(e).__name__


def _row(path: str, rgb: np.ndarray | None, error: str, extra: Sequence[Measure], hashes: bool) -> dict:
    if rgb is None:
        return {"image_path": path, "is_readable": False, "load_error": error}
    row = {"image_path": path, "width": rgb.shape[1], "height": rgb.shape[0], "is_readable": True, "load_error": None}
    if hashes:
        row |= {"ahash_bits": kernels.average_hash(rgb), "dhash_bits": kernels.difference_hash(rgb)}
    return row | {m.name: m.value(rgb) for m in extra}


class _Quality:
    """Quality measures of rows, computed together for images of one size; small ones cost mostly calls."""

    def __init__(self):
        self.sizes: dict[tuple[int, ...], list[tuple[dict, np.ndarray]]] = {}
        self.held = 0

    def add(self, row: dict, rgb: np.ndarray) -> None:
        self.sizes.setdefault(rgb.shape, []).append((row, rgb))
        self.held += rgb.nbytes
        if self.held >= STACKED:
            self.settle()

    def settle(self) -> None:
        for some in self.sizes.values():
            found = kernels.qualities(np.stack([x for _, x in some]) if len(some) > 1 else some[0][1][None])
            for (row, _), values in zip(some, zip(*(x.tolist() for x in found.values()), strict=True), strict=True):
                row.update(zip(found, values, strict=True))
        self.sizes, self.held = {}, 0


def _measure(embed: Embedder | None, decoder: Decoder | None, extra: Sequence[Measure], quality: bool = True, hashes: bool = True):
    model = embed if isinstance(embed, Batched) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        waiting: list[tuple[dict, np.ndarray]] = []
        measures = _Quality()

        def out() -> pa.RecordBatch:
            measures.settle()
            if waiting:
                for (row, _), vector in zip(waiting, model.vectors([x for _, x in waiting]), strict=True):
                    row["embedding"] = vector
            made = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[k]) for n, k in columns], [n for n, _ in columns])
            rows.clear()
            waiting.clear()
            return made

        columns = measured_columns(extra)
        for batch in batches:
            for path, rgb, error in _pictures(batch, decoder):
                rows.append(_row(path, rgb, error, extra, hashes))
                if quality and rgb is not None:
                    measures.add(rows[-1], rgb)
                if model is None:
                    if rgb is not None and embed is not None:
                        rows[-1]["embedding"] = embed(rgb)
                elif rgb is not None or model.blank:
                    waiting.append((rows[-1], model.fitted(rgb)))
                if model is not None and (len(waiting) == model.size or len(rows) == WAITING):
                    yield out()
            if rows and not waiting:
                yield out()
        if rows:
            yield out()

    return run


def measure(images: DataFrame, embed: Embedder | None = kernels.grid_embedding, decoder: Decoder | None = None, extra: Sequence[Measure] = (), quality: bool = True, hashes: bool = True) -> DataFrame:
    """Of decode(), or of contents() with a decoder: sizes, quality measures, `extra` ones, hashes and embeddings, in one pass over the pixels. Unreadable files keep their row.

    A caller who doesn't read the quality measures, or the hashes, turns them off: they are null then, as an embedding without `embed` is.
    """
    return images.mapInArrow(_measure(embed, decoder, tuple(extra), quality, hashes), ", ".join(f"`{n}` {k}" for n, k in measured_columns(extra)))
