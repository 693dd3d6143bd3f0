"""What queries shuffle on unclustered vectors grows with the table, not with its square."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from lensaudit.operators import neighbours, vectors


def shuffled(spark, action) -> int:
    """Bytes that the stages of an action's jobs wrote to shuffles."""
    context = spark.sparkContext
    context.setJobGroup("growth", "")
    seen = set(context.statusTracker().getJobIdsForGroup("growth"))
    action()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in set(tracker.getJobIdsForGroup("growth")) - seen for s in tracker.getJobInfo(j).stageIds}
    context.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


@pytest.mark.parametrize("name", ["knn_distance", "outlier_combined"])
def test_shuffled_bytes_follow_the_table(spark, tmp_path, monkeypatch, name):
    for module, part, value in ((neighbours, "CELL", 16), (neighbours, "GROUPS", 4), (neighbours, "LEAST", 1), (neighbours, "BLOCK", 64), (vectors, "BLOCK", 64)):
        monkeypatch.setattr(module, part, value, raising=False)
    took = []
    for n in (1000, 4000):
        x = np.random.default_rng(n).normal(size=(n, 24)).astype(np.float32)
        df = spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>, label int")
        df.write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        took.append(shuffled(spark, lambda n=n: entry.queries()[name](spark, f"{tmp_path}/{n}").write.format("noop").mode("overwrite").save()))
    assert 0 < took[1] < 4 * 1.4 * took[0], took


def test_few_equal_and_far_vectors(spark, monkeypatch):
    """Where single precision can't tell pairs apart, and where a block holds fewer rows than there are neighbours to find."""
    for part, value in (("CELL", 20), ("GROUPS", 5), ("LEAST", 1), ("BLOCK", 30)):
        monkeypatch.setattr(neighbours, part, value, raising=False)
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=(400, 6)) * 1e-3 + rng.integers(0, 3, (400, 1)) * 1e6, rng.normal(size=(400, 6)) * 1e20, np.vstack((np.ones((300, 6)), rng.normal(size=(100, 6))))):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "_i bigint, _v array<double>")
        got = {r["_i"]: [e["d"] for e in r["near"]] for r in neighbours.nearest(df, 40).collect()}
        want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, :40]
        assert np.allclose([got[i] for i in range(400)], want, rtol=1e-12, atol=0)


def test_every_table_of_more_than_a_block_has_as_many_copies(spark, monkeypatch):
    """Groups once grew with the table up to 36 of 1,024 rows, so that shuffled bytes grew with its square until then."""
    monkeypatch.setattr(neighbours, "BLOCK", 1000)
    took = []
    for n in (4000, 12000):
        x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "_i bigint, _v array<float>").cache()
        took.append(shuffled(spark, lambda df=df: neighbours.nearest(df, 4).write.format("noop").mode("overwrite").save()))
    assert 0 < took[1] < 3 * 1.2 * took[0], took


def test_neighbours_are_searched_once_for_combined_scores(spark, monkeypatch, tmp_path):
    """The ranges of scores and the rows once searched anew, each from the shuffled copies."""
    for module, part, value in ((neighbours, "CELL", 16), (neighbours, "GROUPS", 4), (neighbours, "LEAST", 1), (vectors, "BLOCK", 64)):
        monkeypatch.setattr(module, part, value)
    x = np.random.default_rng(0).normal(size=(1000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = spark.sparkContext.accumulator(0)
    met = neighbours._met

    def counted(*args):
        run = met(*args)
        return lambda batches: (seen.add(1), run(batches))[1]

    monkeypatch.setattr(neighbours, "_met", counted)
    entry.queries()["outlier_combined"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert seen.value == 4  # a task a group
