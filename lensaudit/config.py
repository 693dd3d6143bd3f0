"""Parameters of an audit."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

#: Fixed by the accepted input: suffixes of image files, in any case.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
#: Fixed by the outputs: names of the quality measures, in their order.
QUALITY_METRICS = ("brightness", "contrast", "blur_score", "saturation", "white_pixel_ratio", "bright_region_count", "entropy")


#: Columns that an audit makes itself, besides the measures: a measure of one's own can't have such a name.
TAKEN = (
    "row_index", "image_path", "label", "source_domain", "filename", "file_size_bytes", "is_readable", "load_error", "width", "height", "aspect_ratio", "resolution_bucket", "analysis_domain",
    "analysis_domain_kind", "ahash", "dhash", "ahash_bits", "dhash_bits", "embedding",
)


@dataclass(frozen=True)
class Measure:
    """A measure of one's own: a number (or truth value, as 0 or 1) for the pixels of an image, height x width x RGB in 8 bits.

    It is taken in the pass that decodes an image, and is then in all tables, charts, effects and outlier scores beside the others. None and NaN count as missing,
    and a row that lacks a measure has no outlier score; what the kernel raises ends the run. Kernels are sent to tasks: use functions of modules that workers can import.
    """

    name: str
    kernel: Callable[[np.ndarray], float | None]
    kind: str = "double"

    def __post_init__(self) -> None:
        if not re.fullmatch("[A-Za-z][A-Za-z0-9_]*", self.name) or self.name.lower() in (*QUALITY_METRICS, *TAKEN) or self.name.startswith(("embedding_", "outlier_")):
            raise ValueError(f"{self.name!r} can't be the name of a measure")
        if self.kind not in ("double", "bigint", "int"):
            raise ValueError("a measure is a double, a bigint or an int")

    def value(self, rgb: np.ndarray) -> float | int | None:
        x = self.kernel(rgb)
        return None if x is None else float(x) if self.kind == "double" else int(x)


@dataclass(slots=True)
class AuditConfig:
    dataset_root: str | None = None
    csv_path: str | None = None
    path_root: str | None = None
    image_column: str = "image_path"
    label_column: str = "label"
    source_column: str | None = None
    output_dir: str = "outputs/default_run"
    max_images: int | None = None
    recursive: bool = True
    quality_metrics: tuple[str, ...] = QUALITY_METRICS
    #: Measures beside these; validate() adds their names to quality_metrics.
    measures: tuple[Measure, ...] = ()
    #: Images that a worker holds at a time.
    batch_size: int = 32
    #: CSV tables as folders of ordered parts, written by many tasks, in place of one file each.
    csv_folders: bool = False
    seed: int = 42
    #: The projection beside PCA: tsne or umap.
    projection: str = "tsne"
    montage_tile: int = 180
    montage_columns: int = 5
    extremes_k: int = 20
    outlier_k: int = 25
    duplicate_k: int = 25
    hamming_threshold: int = 6
    effect_threshold: float = 0.8
    effect_rows: int = 10
    report_title: str = "Image audit"
    #: Rows of a report's lists.
    report_rows: int = field(default=8)

    def validate(self) -> AuditConfig:
        """Resolves paths, leaves URIs as they are; a folder or a CSV must be given, the CSV wins."""
        if not self.dataset_root and not self.csv_path:
            raise ValueError("give dataset_root or csv_path")
        if self.max_images is not None and self.max_images < 0:
            raise ValueError("max_images can't be negative")
        if self.projection not in ("tsne", "umap"):
            raise ValueError("projection is tsne or umap")
        if self.batch_size < 1:
            raise ValueError("batch_size can't be less than 1")
        names = [m.name for m in self.measures]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError("two measures have one name")
        self.quality_metrics = (*self.quality_metrics, *(n for n in names if n not in self.quality_metrics))
        if unknown := [m for m in self.quality_metrics if m not in (*QUALITY_METRICS, *names)]:
            raise ValueError(f"no measure is called {', '.join(unknown)}")
        for name in ("dataset_root", "csv_path", "path_root", "output_dir"):
            value = re.sub("^file:/+", "/", getattr(self, name) or "")
            if value and "://" not in value:
                setattr(self, name, str(Path(value).expanduser().resolve()))
        return self
