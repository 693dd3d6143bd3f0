from __future__ import annotations

import numpy as np
import pytest

from lensaudit.config import AuditConfig, Measure
from lensaudit.functions import kernels, models
from lensaudit.functions.png import encode_png
from lensaudit.plans import audit, cli
from lensaudit.sources import images


def drawn(n, seed=0, bottleneck=False):
    """Weights of a small network by the public names: two stages of n blocks, the second with a short cut of its own."""
    rng, weights = np.random.default_rng(seed), {}

    def layer(conv, norm, outputs, inputs, side):
        weights[f"{conv}.weight"] = rng.normal(size=(outputs, inputs, side, side), scale=(inputs * side * side) ** -0.5).astype(np.float32)
        for name, x in (("weight", rng.uniform(0.5, 1.5, outputs)), ("bias", rng.normal(size=outputs)), ("running_mean", rng.normal(size=outputs)), ("running_var", rng.uniform(0.5, 2, outputs))):
            weights[f"{norm}.{name}"] = x.astype(np.float32)

    layer("conv1", "bn1", 4, 3, 7)
    inputs = 4
    for stage, width in ((1, 4), (2, 6)):
        for block in range(n):
            at, outputs = f"layer{stage}.{block}", width * (2 if bottleneck else 1)
            shape = [(width, inputs, 1), (width, width, 3), (outputs, width, 1)] if bottleneck else [(width, inputs, 3), (width, width, 3)]
            for i, (o, c, side) in enumerate(shape, 1):
                layer(f"{at}.conv{i}", f"{at}.bn{i}", o, c, side)
            if block == 0 and (stage > 1 or inputs != outputs):
                layer(f"{at}.downsample.0", f"{at}.downsample.1", outputs, inputs, 1)
            inputs = outputs
    return weights


def plain_convolve(x, w, stride, pad):
    """One image (channels x height x width), cell by cell."""
    outputs, channels, high, wide = w.shape
    x = np.pad(x, ((0, 0), (pad, pad), (pad, pad)))
    out = np.zeros((outputs, (x.shape[1] - high) // stride + 1, (x.shape[2] - wide) // stride + 1))
    for o in range(outputs):
        for i in range(out.shape[1]):
            for j in range(out.shape[2]):
                out[o, i, j] = (x[:, i * stride : i * stride + high, j * stride : j * stride + wide] * w[o]).sum()
    return out


def plain_vector(weights, x):
    """The same network for one normalised image (height x width x channels), with normalisation as a step of its own."""
    w = {k: v.astype(np.float64) for k, v in weights.items()}

    def layer(x, conv, norm, stride):
        y = plain_convolve(x, w[f"{conv}.weight"], stride, w[f"{conv}.weight"].shape[2] // 2)
        p = [w[f"{norm}.{n}"][:, None, None] for n in ("running_mean", "running_var", "weight", "bias")]
        return (y - p[0]) / np.sqrt(p[1] + 1e-5) * p[2] + p[3]

    x = np.maximum(layer(x.transpose(2, 0, 1).astype(np.float64), "conv1", "bn1", 2), 0)
    wide = np.pad(x, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    x = np.array([[[c[i : i + 3, j : j + 3].max() for j in range(0, c.shape[1] - 2, 2)] for i in range(0, c.shape[0] - 2, 2)] for c in wide])
    blocks = sorted({k.rsplit(".conv1", 1)[0] for k in w if k.startswith("layer") and ".conv1." in k})
    for at in blocks:
        stride = 2 if not at.startswith("layer1.") and at.endswith(".0") else 1
        if f"{at}.conv3.weight" in w:
            y = np.maximum(layer(x, f"{at}.conv1", f"{at}.bn1", 1), 0)
            y = np.maximum(layer(y, f"{at}.conv2", f"{at}.bn2", stride), 0)
            y = layer(y, f"{at}.conv3", f"{at}.bn3", 1)
        else:
            y = layer(np.maximum(layer(x, f"{at}.conv1", f"{at}.bn1", stride), 0), f"{at}.conv2", f"{at}.bn2", 1)
        short = layer(x, f"{at}.downsample.0", f"{at}.downsample.1", stride) if f"{at}.downsample.0.weight" in w else x
        x = np.maximum(y + short, 0)
    return x.mean((1, 2))


@pytest.mark.parametrize("stride, pad, side", [(1, 1, 3), (2, 3, 7), (2, 0, 1), (1, 0, 2)])
def test_convolution_against_plain_sums(stride, pad, side, monkeypatch):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(5, 9, 11, 3)), rng.normal(size=(4, 3, side, side))
    for held in (1, 1 << 25):  # one image at a time, all at once
        monkeypatch.setattr(models, "HELD", held)
        got = models.convolve(x, w, stride, pad)
        assert np.allclose(got, np.stack([plain_convolve(a.transpose(2, 0, 1), w, stride, pad).transpose(1, 2, 0) for a in x]))


@pytest.mark.parametrize("n, bottleneck", [(1, False), (2, False), (2, True)])
def test_network_against_plain_layers(n, bottleneck):
    weights = drawn(n, bottleneck=bottleneck)
    x = np.random.default_rng(2).normal(size=(3, 20, 20, 3)).astype(np.float32)
    got = models.Residual(weights)(x)
    assert got.shape == (3, 12 if bottleneck else 6) and np.allclose(got, [plain_vector(weights, a) for a in x], atol=1e-4)
    del weights["layer2.0.bn2.bias"]
    with pytest.raises(ValueError, match="layer2.0.bn2.bias"):
        models.Residual(weights)


@pytest.fixture(scope="module")
def shades(tmp_path_factory):
    """70 images, two of them broken."""
    root = tmp_path_factory.mktemp("shades")
    for i in range(70):
        x = np.full((5 + i % 3, 8, 3), i, np.uint8)
        x[0] = 255 - i
        at = root / "ab"[i % 2]
        at.mkdir(exist_ok=True)
        (at / f"p{i:02d}.png").write_bytes(b"junk" if i in (3, 40) else encode_png(x))
    return root


class Noting:
    """Tells the size of its batch, and the mean of each image before it was normalised."""

    def __call__(self, x):
        assert x.dtype == np.float32 and x.shape[1:] == (6, 6, 3)
        means = (x * np.float32(models.CHANNEL_DEVIATION) + np.float32(models.CHANNEL_MEAN)).mean((1, 2, 3)) * 255
        return np.column_stack((np.full(len(x), len(x)), means))


@pytest.mark.parametrize("arrow, blank", [(7, False), (10000, False), (7, True)])
def test_a_model_sees_full_batches(spark, shades, arrow, blank):
    before = spark.conf.get(audit.BATCH)
    spark.conf.set(audit.BATCH, arrow)
    try:
        pictures = images.decode(spark, [str(shades)]).coalesce(1)
        rows = images.measure(pictures, models.Batched(Noting(), 6, blank=blank)).collect()
    finally:
        spark.conf.set(audit.BATCH, before)
    assert len(rows) == len({r["image_path"] for r in rows}) == 70
    seen = [r for r in rows if r["embedding"] is not None]
    assert sum(not r["is_readable"] for r in rows) == 2 and len(seen) == (70 if blank else 68)
    assert sorted(r["embedding"][0] for r in seen) == [len(seen) - 64] * (len(seen) - 64) + [32] * 64
    for r in seen:
        i = int(r["image_path"][-6:-4])
        mean = (5 + i % 3 - 1) / (5 + i % 3) * i + (255 - i) / (5 + i % 3)
        assert abs(r["embedding"][1] - (mean if r["is_readable"] else 0)) < 12


def test_a_model_that_loses_rows_is_refused(shades):
    with pytest.raises(ValueError, match="for 2 images"):
        models.Batched(lambda x: x[:1, :, 0, 0], 4).vectors([np.zeros((4, 4, 3), np.uint8)] * 2)


def test_weights_of_a_file_by_the_command_line(spark, shades, tmp_path):
    np.savez(tmp_path / "w.npz", **drawn(1))
    some = tmp_path / "some"
    for i in range(6):
        (some / "ab"[i % 2]).mkdir(parents=True, exist_ok=True)
        name = f"{'ab'[i % 2]}/p{i + 10}.png"
        (some / name).write_bytes((shades / name).read_bytes())
    out = tmp_path / "out"
    cli.main(["audit", "--dataset-root", str(some), "--output-dir", str(out), "--weights", str(tmp_path / "w.npz"), "--image-size", "24", "--measure", "lensaudit.functions.kernels:saturation_mean"])
    rows = spark.read.parquet(str(out / "spine.parquet")).collect()
    for r in rows:
        picture = np.full((5 + int(r["image_path"][-6:-4]) % 3, 8, 3), int(r["image_path"][-6:-4]), np.uint8)
        picture[0] = 255 - picture[1, 0]
        x = (kernels.resize(picture, 24, 24).astype(np.float64) / 255 - models.CHANNEL_MEAN) / models.CHANNEL_DEVIATION
        assert np.allclose(r["embedding"], plain_vector(drawn(1), x), atol=1e-4)
        assert r["saturation_mean"] == r["saturation"] == kernels.saturation_mean(picture)
    assert "w.npz" in (out / "embeddings/embedding_summary.md").read_text()
    with pytest.raises(OSError):
        models.network(str(tmp_path / "none.npz"))


def red_share(rgb):
    total = int(rgb.sum())
    return rgb[..., 0].sum() / total if total else None


def test_a_measure_of_ones_own(spark, tmp_path, monkeypatch):
    """It flows into tables, effects, outliers and the report, and a manifest's values stand in where an image gives none."""
    rng, root = np.random.default_rng(3), tmp_path / "set"
    for label in "ab":
        (root / label).mkdir(parents=True)
        for i in range(12):
            x = rng.integers(40, 60, (6, 7, 3)).astype(np.uint8)
            x[..., 0] += 120 if label == "b" else 0
            (root / label / f"{i}.png").write_bytes(encode_png(x))
    (root / "a" / "black.png").write_bytes(encode_png(np.zeros((4, 4, 3), np.uint8)))
    (root / "a" / "broken.png").write_bytes(b"junk")
    own = (Measure("red_share", red_share), Measure("cells", lambda rgb: rgb.shape[0] * rgb.shape[1], "bigint"))
    out = tmp_path / "out"
    spine = audit.run_audit(spark, AuditConfig(dataset_root=str(root), output_dir=str(out), measures=own))
    by = {r["image_path"].removeprefix(f"{root}/"): r for r in spine.collect()}
    assert by["a/black.png"]["red_share"] is None and by["a/black.png"]["cells"] == 16 and by["a/broken.png"]["cells"] is None
    assert by["b/1.png"]["red_share"] > 0.5 > by["a/1.png"]["red_share"] and by["b/1.png"]["cells"] == 42
    effects = spark.read.csv(str(out / "bias_quality_effects_by_class.csv"), header=True)
    assert {r["metric"] for r in effects.collect()} >= {"red_share", "cells", "entropy"} and effects.where("metric = 'red_share' AND suspicious_shortcut_signal = 'true'").count() == 2
    assert "red_share" in (out / "final_report.md").read_text() and (out / "quality/cells_hist.svg").exists() and (out / "quality/red_share_lowest.csv").exists()
    assert by["a/black.png"]["outlier_score"] is None and by["a/1.png"]["outlier_score"] is not None  # a row without one of the measures isn't scored
    assert "red_share" not in (out / "dataset_manifest.csv").read_text().splitlines()[0] and "red_share" in (out / "dataset_manifest_with_quality.csv").read_text().splitlines()[0]
    path = tmp_path / "m.csv"
    path.write_text(f"image_path,label,red_share\n{root}/b/1.png,b,0.125\n{root}/a/broken.png,a,0.25\n")
    rows = audit.ingest(spark, AuditConfig(csv_path=str(path), measures=own).validate()).orderBy("row_index").collect()
    assert rows[0]["red_share"] == by["b/1.png"]["red_share"] and rows[1]["red_share"] == 0.25


@pytest.mark.parametrize("name, kind", [("label", "double"), ("Entropy", "double"), ("a b", "double"), ("embedding_001", "double"), ("x", "string")])
def test_measures_that_are_refused(name, kind):
    with pytest.raises(ValueError):
        Measure(name, red_share, kind)
    with pytest.raises(ValueError):
        AuditConfig(dataset_root="x", measures=(Measure("x", red_share), Measure("X", red_share))).validate()
    with pytest.raises(ValueError):
        AuditConfig(dataset_root="x", quality_metrics=("sharpness",)).validate()
