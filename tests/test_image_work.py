"""What is computed of an image: what is asked for, and what depends on its size alone once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lensaudit.functions import kernels
from lensaudit.sources import images

ROW = [("a", 10, 12, 3, bytes(range(120)) * 3)]


@pytest.mark.parametrize("off", ["quality", "hashes"])
def test_only_what_is_asked_for(spark, off):
    df = spark.createDataFrame(ROW, "image_path string, height int, width int, nChannels int, data binary")
    whole, part = images.measure(df, None).first(), images.measure(df, None, **{off: False}).first()
    gone = {"quality": images.QUALITY_METRICS, "hashes": ("ahash_bits", "dhash_bits")}[off]
    assert all(part[c] is None if c in gone else part[c] == whole[c] for c in whole.asDict()) and all(whole[c] is not None for c in gone)


def test_weights_of_a_size_are_computed_once(monkeypatch):
    calls = []
    cubic = kernels._cubic
    monkeypatch.setattr(kernels, "_cubic", lambda x: calls.append(1) or cubic(x))
    for seed in range(5):
        kernels.average_hash(np.random.default_rng(seed).integers(0, 256, (37, 53, 3)).astype(np.uint8))
    assert len(calls) <= 2


def test_image_measures_skips_hashes(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    asked = []
    measure = images.measure
    monkeypatch.setattr(images, "measure", lambda *a, **k: asked.append(k) or measure(*a, **k))
    assert {"ahash_bits", "dhash_bits"}.isdisjoint(entry.queries()["image_measures"](spark, sf_dir).columns) and asked == [{"hashes": False}]


def test_images_of_one_size_are_measured_together(monkeypatch):
    """Once each image had calls of its own; now all images of a size share them, with the same values."""
    rng = np.random.default_rng(0)
    shapes = [(10, 12, 3), (7, 5, 3), (-1, -1, -1), (4, 4, 1)]
    rows = [(f"{i}", *shapes[i % 4], rng.choice([0, 90, 250], abs(int(np.prod(shapes[i % 4])))).astype(np.uint8).tobytes()) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["image_path", "height", "width", "nChannels", "data"])
    calls, qualities = [], kernels.qualities
    monkeypatch.setattr(kernels, "qualities", lambda x: calls.append(len(x)) or qualities(x))
    got = [r for part in images._measure(None, None, (), hashes=False)(iter([batch])) for r in part.to_pylist()]
    assert sorted(calls) == [150, 150, 150] and [r["image_path"] for r in got] == [r[0] for r in rows]
    for row, measured in zip(rows, got, strict=True):
        want = kernels.quality(images.pixels(*row[1:])) if row[1] > 0 else dict.fromkeys(images.QUALITY_METRICS)
        assert {m: measured[m] for m in want} == pytest.approx(want) and measured["is_readable"] == (row[1] > 0)


def test_few_pixels_wait_to_be_measured(monkeypatch):
    monkeypatch.setattr(images, "STACKED", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[ROW[0]] * 9, strict=True)], ["image_path", "height", "width", "nChannels", "data"])
    calls, qualities = [], kernels.qualities
    monkeypatch.setattr(kernels, "qualities", lambda x: calls.append(len(x)) or qualities(x))
    list(images._measure(None, None, ())(iter([batch])))
    assert calls == [3, 3, 3]


def test_regions_stay_in_their_image():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.5, 0.8, 1.0):
        masks = rng.random((40, 9, 13)) < share
        size, image = kernels._regions(masks)
        assert all(sorted(size[image == i].tolist()) == sorted(kernels.region_sizes(m)) for i, m in enumerate(masks))


def test_drawn_images_by_the_formula(spark, sf_dir):
    from lensaudit import queries

    def colour(k, r, x, c):
        return 250 + (k + x) % 6 if (r // 5 + x // 6 + k) % 3 == 0 else (k * 31 + r * r * 17 + x * x * 7 + r * x * (c + 1) * 5 + c * 61) % 240

    drawn = queries._drawn_images(spark, sf_dir).collect()
    assert len(drawn) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    for row in drawn:
        want = [colour(int(row["image_path"]), r, x, c) for r in range(10) for x in range(12) for c in (2, 1, 0)]
        assert list(row["data"]) == want and (row["height"], row["width"], row["nChannels"]) == (10, 12, 3)
