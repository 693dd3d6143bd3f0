"""What the rounds of a layout leave on disk."""

from __future__ import annotations

import os

import pytest

from lensaudit.operators import tsne, umap
from lensaudit.scratch import settled

from .test_neighbours import clustered
from .test_umap import frame


@pytest.mark.parametrize("module, run", [(umap, lambda df: umap.umap(df, "id", "v", epochs=10)), (tsne, lambda df: tsne.tsne(df, "id", "v", steps=20))], ids=["umap", "tsne"])
def test_rounds_leave_one_table_and_no_shuffles(spark, monkeypatch, module, run):
    monkeypatch.setattr(module, "BLOCK", 100)
    monkeypatch.setattr(module, "ROUNDS", 4)
    settled(spark.range(1))
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(at))
    assert run(frame(spark, clustered(300, 4, width=5))).count() == 300
    assert len(set(os.listdir(at)) - before) == 2  # the points and where they are
