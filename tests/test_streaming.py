from __future__ import annotations

import numpy as np

from lensaudit.functions.png import encode_png
from lensaudit.streaming.watch import watch


def test_images_are_measured_once_as_they_arrive(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    at = root / "site" / "cat"
    at.mkdir(parents=True)

    def run():
        watch(spark, str(root), out, str(tmp_path / "state"), once=True).awaitTermination(120)
        return sorted((r["filename"], r["label"], r["source_domain"], r["is_readable"], r["brightness"]) for r in spark.read.parquet(out).collect())

    (at / "a.png").write_bytes(encode_png(np.full((8, 8, 3), 90, np.uint8)))
    assert run() == [("a.png", "cat", "site", True, 90.0)]
    (at / "b.PNG").write_bytes(b"junk")
    assert run() == [("a.png", "cat", "site", True, 90.0), ("b.PNG", "cat", "site", False, None)] == run()
