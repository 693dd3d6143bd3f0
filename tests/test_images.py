from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensaudit.config import AuditConfig
from lensaudit.functions import kernels as K
from lensaudit.functions.png import encode_png
from lensaudit.plans import audit, cli
from lensaudit.sources import files, images, records


def solid(*rgb, size=(20, 30)):
    return np.full((*size, 3), rgb, np.uint8)


def test_solid_image():
    assert K.quality(solid(128, 128, 128)) == {"brightness": 128, "contrast": 0, "blur_score": 0, "saturation": 0, "white_pixel_ratio": 0, "bright_region_count": 0, "entropy": 0}
    assert K.average_hash(solid(9, 9, 9)) == K.difference_hash(solid(9, 9, 9)) == -1


def test_half_black_half_white():
    x = solid(0, 0, 0, size=(10, 10))
    x[:, 5:] = 255
    q = K.quality(x)
    assert (q["contrast"], q["entropy"], q["white_pixel_ratio"]) == (127.5, 1.0, 0.5)
    assert K.quality(solid(255, 0, 0))["saturation"] == 255


@pytest.mark.parametrize("blocks, count", [([(2, 2, 5, 4)], 1), ([(2, 2, 19, 1)], 0), ([(2, 2, 5, 4), (7, 6, 5, 4)], 1), ([(2, 2, 5, 4), (12, 12, 4, 5)], 2)])
def test_bright_regions(blocks, count):
    x = solid(0, 0, 0, size=(30, 30))
    for r, c, h, w in blocks:
        x[r : r + h, c : c + w] = 250
    assert K.quality(x)["bright_region_count"] == count


def test_regions_against_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(30):
        mask = rng.random((15, 15)) < 0.45
        left, sizes = {tuple(p) for p in np.argwhere(mask)}, []
        while left:
            todo, n = [left.pop()], 0
            while todo:
                r, c = todo.pop()
                n += 1
                near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            sizes.append(n)
        assert sorted(K.region_sizes(mask)) == sorted(sizes)


def test_ramps_and_resize():
    ramp = np.repeat(np.tile(np.arange(0, 240, 5, dtype=np.uint8), (24, 1))[..., None], 3, 2)
    assert K.difference_hash(ramp) == -1 and K.difference_hash(ramp[:, ::-1]) == 0
    assert (K.resize(solid(7, 8, 9), 5, 5) == (7, 8, 9)).all() and K.resize(ramp, 48, 24).tolist() == ramp.tolist()
    assert K.grid_embedding(ramp).shape == (512,)
    assert np.isfinite(list(K.quality(solid(1, 2, 3, size=(1, 32))).values())).all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("set") / "data 1+2"
    rng = np.random.default_rng(1)
    for site in ("siteA", "siteB"):
        for label, shade in (("cat", 60), ("dog", 180)):
            at = root / site / label
            at.mkdir(parents=True)
            for i in range(6):
                x = np.clip(rng.normal(shade + (40 if site == "siteB" else 0), 12, (24, 32, 3)), 0, 255).astype(np.uint8)
                (at / f"im {i}.PNG").write_bytes(encode_png(x))
    (root / "siteA" / "cat" / "copy.png").write_bytes((root / "siteA" / "cat" / "im 0.PNG").read_bytes())
    (root / "siteA" / "dog" / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"junk")
    (root / "siteA" / "dog" / "text.jpg").write_text("no image")
    (root / "siteA" / "dog" / "notes.txt").write_text("not listed")
    return root


def test_audit_of_a_folder(spark, folder, tmp_path):
    out = tmp_path / "out"
    config = AuditConfig(dataset_root=str(folder), output_dir=str(out))
    spine = audit.run_audit(spark, config)
    rows = spine.orderBy("row_index").collect()
    assert [r["image_path"] for r in rows] == sorted((r["image_path"] for r in rows), key=lambda p: p.split("/")) and [r["row_index"] for r in rows] == list(range(27))
    assert sum(r["is_readable"] for r in rows) == 25 and {r["analysis_domain"] for r in rows} == {"siteA", "siteB"}
    by = {r["image_path"].removeprefix(str(folder) + "/"): r for r in rows}
    assert by["siteA/dog/broken.png"]["load_error"] and by["siteA/dog/text.jpg"]["width"] is None and by["siteA/dog/text.jpg"]["file_size_bytes"] == 8
    assert by["siteA/cat/im 0.PNG"]["width"] == 32 and by["siteA/cat/im 0.PNG"]["aspect_ratio"] == 1.3333
    names = [
        "dataset_manifest.csv", "corrupted_or_unreadable_images.csv", "class_counts.csv", "image_size_summary.csv", "duplicate_filenames.csv", "dataset_summary.md", "quality/entropy_lowest.csv",
        "quality/quality_metric_summary.csv", "quality/brightness_highest_montage.png", "bias_class_balance.csv", "bias_quality_effects_by_class.csv", "bias_quality_effects_by_domain.csv", "label_by_analysis_domain.csv",
        "suspicious_shortcut_signals.csv", "exact_hash_match_groups.csv", "near_duplicate_pairs.csv", "near_duplicate_pairs_montage.png", "embeddings/embedding_table.csv", "embeddings/pca_by_label.svg",
        "embeddings/tsne_by_source_domain.svg", "outlier_scores.csv", "top_suspicious_samples.csv", "dataset_manifest_final.csv", "multiview_placeholder.md", "final_report.md",
    ]
    assert [n for n in names if not (out / n).exists()] == []
    assert "brightness" in (out / "suspicious_shortcut_signals.csv").read_text()
    assert "copy.png" in (out / "exact_hash_match_groups.csv").read_text()
    scores = [r["outlier_score"] for r in rows if r["is_readable"]]
    assert all(0 <= s <= 1 for s in scores) and all(r["outlier_score"] is None for r in rows if not r["is_readable"])
    cli.main(["html", "--input-md", str(out / "final_report.md")])
    assert "<h1>Image audit</h1>" in (out / "final_report.html").read_text()


def test_audit_of_a_manifest(spark, folder, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("file,kind,site,age,entropy\nsiteA/cat/im 0.PNG,cat,A,3,\nmissing.png,NA,null,4,2.5\nsiteB/../siteB/dog/im 1.PNG,dog,,5,9\n")
    config = AuditConfig(csv_path=str(path), path_root=str(folder), image_column="file", label_column="kind", source_column="site", output_dir=str(tmp_path / "o"))
    rows = audit.ingest(spark, config.validate()).orderBy("row_index").collect()
    assert [r["is_readable"] for r in rows] == [True, False, True] and [r["label"] for r in rows] == ["cat", None, "dog"]
    assert [r["source_domain"] for r in rows] == ["A", None, None] and [r["age"] for r in rows] == [3, 4, 5]
    assert rows[1]["load_error"] and rows[1]["file_size_bytes"] is None and rows[1]["entropy"] == 2.5 and rows[2]["image_path"] == str(folder / "siteB/dog/im 1.PNG")
    assert [r["analysis_domain"] for r in rows] == ["A", "unknown", "unknown"]
    with pytest.raises(ValueError):
        audit.ingest(spark, AuditConfig(csv_path=str(path)).validate())


def test_a_manifest_of_many_folders_outside_its_root(spark, tmp_path):
    """More than 1,000 folders: only path_root was listed, and all images elsewhere were lost."""
    image, lines = encode_png(solid(1, 2, 3, size=(4, 4))), ["image_path,label"]
    for i in range(1005):
        at = tmp_path / "elsewhere" / f"f{i}"
        at.mkdir(parents=True)
        (at / "x.png").write_bytes(image)
        lines.append(f"{at}/x.png,a")
    lines.append(f"{tmp_path}/elsewhere/gone/x.png,a")
    (tmp_path / "root").mkdir()
    path = tmp_path / "m.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = audit.ingest(spark, AuditConfig(csv_path=str(path), path_root=str(tmp_path / "root"), output_dir=str(tmp_path / "o")).validate()).orderBy("row_index").collect()
    assert [r["is_readable"] for r in rows] == [True] * 1005 + [False] and rows[-1]["load_error"] == "no such file"


def test_scatter_charts_show_all_rows(spark, tmp_path, monkeypatch):
    """Of more than 5,000 rows only the first by hash were drawn."""
    monkeypatch.setattr(audit.projection, "tsne", lambda df, index, vector, seed: audit.projection.pca(df, index, vector, "tsne"))
    rng = np.random.default_rng(2)
    rows = [(i, f"/{i}.png", "ab"[i % 2], None, "d", "explicit", float(i % 9), 1.0, [float(x) for x in rng.normal(size=3)]) for i in range(5200)]
    spine = spark.createDataFrame(rows, "row_index bigint, image_path string, label string, source_domain string, analysis_domain string, analysis_domain_kind string, brightness double, blur_score double, embedding array<float>")
    audit.embed_and_project(spine, AuditConfig(dataset_root=str(tmp_path)), audit.Outputs(spine.sparkSession, str(tmp_path / "out")), "none")
    for name in ("pca_by_label", "tsne_by_brightness"):
        svg = (tmp_path / f"out/embeddings/{name}.svg").read_text()
        assert sum(int(n) for n in re.findall(r"<title>(\d+) rows</title>", svg)) == 5200 and "5200 rows in" in svg
    found, n = audit._points(spine.limit(40).withColumns({"x": audit.F.col("brightness"), "y": audit.F.lit(1.0)}), "x", "y", "label")
    assert n == len(found) == 40 and {len(r) for r in found} == {3}


def test_umap_in_place_of_tsne(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f"/{i}.png", "ab"[i % 2], None, "d", "explicit", float(i % 9), 1.0, [float(x) for x in rng.normal(size=3)]) for i in range(30)]
    spine = spark.createDataFrame(rows, "row_index bigint, image_path string, label string, source_domain string, analysis_domain string, analysis_domain_kind string, brightness double, blur_score double, embedding array<float>")
    out, section = audit.embed_and_project(spine, AuditConfig(dataset_root=str(tmp_path), projection="umap").validate(), audit.Outputs(spark, str(tmp_path / "out")), "none")
    assert out.where("umap_x IS NOT NULL").count() == 30 and (tmp_path / "out/embeddings/umap_by_label.svg").exists() and "PCA and UMAP" in section.markdown()
    with pytest.raises(ValueError):
        AuditConfig(dataset_root="x", projection="other").validate()


def test_nothing_readable_and_nothing_at_all(spark, tmp_path):
    for name, files in (("none", {}), ("bad", {"x.png": b"junk"})):
        root = tmp_path / name
        root.mkdir()
        for f, data in files.items():
            (root / f).write_bytes(data)
        spine = audit.run_audit(spark, AuditConfig(dataset_root=str(root), output_dir=str(tmp_path / f"{name}-out")))
        assert spine.count() == len(files)
        assert f"| images listed | {len(files)} |" in (tmp_path / f"{name}-out/final_report.md").read_text()


def test_max_images_and_config(spark, folder, tmp_path):
    config = AuditConfig(dataset_root=str(folder), max_images=5).validate()
    assert audit.ingest(spark, config).count() == 5
    with pytest.raises(ValueError):
        AuditConfig().validate()
    with pytest.raises(ValueError):
        AuditConfig(dataset_root="x", max_images=-1).validate()


def test_pets_manifest(spark, tmp_path):
    at = tmp_path / "annotations"
    at.mkdir()
    (at / "list.txt").write_text("#Image CLASS-ID SPECIES BREED\n\nAbyssinian_1 1 1 1\ngreat_dane_12 2 2 1\nx_3 3 2 2\n")
    (at / "trainval.txt").write_text("Abyssinian_1 1 1 1\n")
    (at / "test.txt").write_text("great_dane_12 2 2 1\nAbyssinian_1 1 1 1\n")
    rows = [tuple(r) for r in records.pets_manifest(spark, str(tmp_path)).collect()]
    assert rows == [
        ("Abyssinian_1", "Abyssinian_1.jpg", "Abyssinian", 1, "cat", 1, "trainval", True, True),
        ("great_dane_12", "great_dane_12.jpg", "great_dane", 2, "dog", 1, "test", False, True),
        ("x_3", "x_3.jpg", "x", 3, "dog", 2, "unknown", False, False),
    ]
    cli.main(["pets", "--dataset-root", str(tmp_path)])
    assert (tmp_path / "pets_manifest.csv").read_text().splitlines()[0].startswith("image_id,image_path,label,class_id")
    (at / "list.txt").write_text("a 1 2\n")
    with pytest.raises(Exception, match="expected four fields"):
        records.pets_manifest(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        records.pets_manifest(spark, str(tmp_path / "nowhere"))


def raw_pixels(data: bytes) -> np.ndarray:
    """A format of the tests' own: RAW, width, height, then RGB."""
    if data[:3] != b"RAW":
        raise ValueError("not RAW")
    return np.frombuffer(data, np.uint8, offset=5).reshape(data[4], data[3], 3)


def test_manifest_of_any_suffix_links_and_a_decoder(spark, folder, tmp_path):
    shade = lambda v: b"RAW" + bytes([6, 4]) + bytes([v]) * 72
    (tmp_path / "real").mkdir()
    for i in range(6):
        (tmp_path / "real" / f"p{i}.dat").write_bytes(shade(30 * i))
    (tmp_path / "linked").symlink_to(tmp_path / "real")
    (tmp_path / "real" / "broken.dat").write_bytes(b"junk")
    (tmp_path / "real" / "png.data").write_bytes((folder / "siteA/cat/im 0.PNG").read_bytes())
    path = tmp_path / "m.csv"
    names = [f"linked/p{i}.dat" for i in range(5)] + [f"file://{tmp_path}/real/p5.dat", "real/broken.dat", "real/png.data"]
    path.write_text("image_path,label,geo_x,size_y\n" + "".join(f"{n},{'ab'[i % 2]},{i},{i * 2}\n" for i, n in enumerate(names)))
    config = AuditConfig(csv_path=str(path), path_root=str(tmp_path), output_dir=str(tmp_path / "o"), batch_size=2, csv_folders=True)
    rows = audit.run_audit(spark, config, decoder=raw_pixels).orderBy("row_index").collect()
    assert [r["is_readable"] for r in rows] == [True] * 6 + [False, False] and rows[6]["load_error"] == "not RAW" and rows[0]["image_path"] == str(tmp_path / "real/p0.dat")
    assert [r["brightness"] for r in rows[:6]] == [0, 30, 60, 90, 120, 150] and (rows[1]["width"], rows[1]["height"]) == (6, 4)
    made = spark.read.csv(str(tmp_path / "o" / "embeddings" / "embedding_table.csv"), header=True)
    assert {"geo_x", "size_y", "embedding_000", "pca_x", "tsne_y"} <= set(made.columns) and made.count() == 8
    assert (tmp_path / "o" / "quality" / "brightness_lowest_montage.png").exists() and (tmp_path / "o" / "dataset_manifest.csv").is_dir()
    by_jvm = audit.ingest(spark, AuditConfig(csv_path=str(path), path_root=str(tmp_path)).validate()).orderBy("row_index").collect()
    assert [r["is_readable"] for r in by_jvm] == [False] * 7 + [True] and by_jvm[7]["width"] == 32


class Opened:
    """A decoder that notes which values it was given, in a folder that all tasks see."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, data: bytes) -> np.ndarray:
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "wb") as f:
            f.write(data[5:6])
        return raw_pixels(data)


@pytest.fixture(scope="module")
def thousand(tmp_path_factory):
    root = tmp_path_factory.mktemp("thousand")
    for i in range(1000):
        (root / f"p{i:03d}.png").write_bytes(encode_png(solid(i % 250, 2, 3, size=(4, 6))) if i % 300 == 7 else b"RAW" + bytes([6, 4]) + bytes([i % 250]) * 72)
    return root


def test_only_named_files_are_opened(spark, thousand, tmp_path):
    """Three of a folder's thousand files, and the first five with max_images: by a decoder of one's own and by the JVM."""
    named = ["p007.png", "p111.png", "p307.png"]
    path = tmp_path / "m.csv"
    path.write_text("image_path,label\n" + "".join(f"{thousand}/{n},a\n" for n in [*named, named[0], "gone.png", ""]))
    seen = tmp_path / "seen"
    seen.mkdir()
    by_csv, by_cap = AuditConfig(csv_path=str(path)).validate(), AuditConfig(dataset_root=str(thousand), max_images=5).validate()
    rows = audit.ingest(spark, by_csv, decoder=Opened(seen)).orderBy("row_index").collect()
    assert [r["is_readable"] for r in rows] == [False, True, False, False, False, False] and rows[4]["load_error"] == "no such file"
    assert sorted(f.read_bytes() for f in seen.iterdir()) == [b"\n", b"\n", bytes([111])]  # the two others hold PNG, which this decoder refuses
    assert audit.ingest(spark, by_cap, decoder=Opened(seen)).where("is_readable").count() == 5 and len(list(seen.iterdir())) == 3 + 5
    rows = records.csv_records(records.read_manifest(spark, str(path)), "image_path", "label", None, None, "/")
    pictures = images.decode_named(spark, images.list_named(rows))
    assert sorted(f.rsplit("/", 1)[1] for f in pictures.inputFiles()) == named
    assert [r["is_readable"] for r in audit.ingest(spark, by_csv).orderBy("row_index").collect()] == [True, False, True, True, False, False]
    capped = records.folder_records(images.list_files(spark, [str(thousand)]), str(thousand), 5)
    assert len(images.decode_named(spark, images.list_named(capped)).inputFiles()) == 5
    assert audit.ingest(spark, by_cap).count() == 5


def test_named_files_by_uri_and_odd_names(spark, tmp_path):
    odd = ["a b.dat", "[x]{y}*?.dat", "é+%20.dat", "#.dat"]
    for n in odd:
        (tmp_path / n).write_bytes(b"RAW" + bytes([6, 4]) + bytes([9]) * 72)
    (tmp_path / "folder").mkdir()
    paths = [f"{tmp_path}/{n}" for n in [*odd, odd[0], "folder", "none"]] + [None]
    df = spark.createDataFrame([(p,) for p in paths], "image_path string")
    assert sorted(tuple(r) for r in images.list_named(df).collect()) == sorted((f"{tmp_path}/{n}", 77) for n in odd)
    assert {len(r["content"]) for r in images.contents_named(df).collect()} == {77} and images.list_named(df.limit(0)).count() == 0
    assert files.sizes([f"file://{tmp_path}/a b.dat".replace(" ", "%20"), f"file://{tmp_path}/none"]) == [77, None]
    assert images.named_by_tasks(df) and not images.named_by_tasks(spark.createDataFrame([("viewfs://store/x",)], "image_path string"))
    assert images.decode_named(spark, images.list_named(df.limit(0))).count() == 0


def test_outputs_below_a_uri(spark, tmp_path):
    out = audit.Outputs(spark, f"file://{tmp_path}/deep/er")
    out.text("a/note.md", "é")
    out.data("x.bin", bytes(range(256)))
    out.csv("t.csv", spark.range(3).withColumn("v.w", F.lit('q"')))
    out.csv("t.csv", spark.range(5).orderBy("id"))
    out.csv("none.csv", spark.range(0))
    at = tmp_path / "deep" / "er"
    assert (at / "a" / "note.md").read_text(encoding="utf-8") == "é" and (at / "x.bin").read_bytes() == bytes(range(256))
    assert (at / "t.csv").read_text().split() == ["id", *"01234"] and (at / "none.csv").read_text().split() == ["id"] and not list(at.glob("*.parts"))
    assert out.table("p.parquet", spark.range(4)).count() == 4
    assert files.exists(spark, f"file://{at}/t.csv") and not files.exists(spark, f"file://{at}/t.csv", folder=True) and not files.exists(spark, f"file://{at}/u")
    assert files.normal("mem://host/a/../b//c") == "mem://host/b/c"
