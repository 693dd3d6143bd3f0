"""Operators on a stock session: no spark.checkpoint.dir, no settings; nothing may be left when the driver has ended."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from lensaudit.llm import common, registry

from .helpers import frame, odd_rows

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from lensaudit.llm import common, registry
assert spark.conf.get("spark.checkpoint.dir", None) is None or sys.argv[1:]
before = {k: spark.conf.get(k, None) for k in (common._BATCHES, common._CLEANUP)}
for name, query in registry.queries().items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
    print("ran", name, flush=True)
common.materialize(spark.range(3))
print("folder", common.shared_dir(spark))
"""


@pytest.mark.parametrize("set_folder", [False, True])
def test_queries_on_a_stock_session_leave_nothing(tmp_path, set_folder):
    conf, shared = tmp_path / "conf", tmp_path / "shared"
    conf.mkdir()
    shared.mkdir()
    if set_folder:
        (conf / "spark-defaults.conf").write_text(f"spark.checkpoint.dir {shared}\n")
    env = {**os.environ, "SPARK_CONF_DIR": str(conf), "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT, *(["set"] if set_folder else [])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert done.stdout.count("ran ") == len(registry.queries())
    assert not list(shared.glob("llm-*")) and not list(tmp_path.glob("lensaudit-*/llm-*"))  # an empty folder there is Spark's own


def test_settings_are_put_back_and_used_tables_are_deleted(spark):
    names = (common._BATCHES, common._CLEANUP)
    before = [spark.conf.get(n, None) for n in names]
    seen = []

    @common.operator
    def work(df):
        seen.append([spark.conf.get(n, None) for n in names])
        first = common.materialize(df)
        second = common.materialize(first.limit(2))
        seen.append([first._llm_path, second._llm_path])
        return second

    out = work(frame(spark, odd_rows()))
    assert [spark.conf.get(n, None) for n in names] == before and seen[0][1] == "true"
    there = [(lambda p, s: s.exists(p))(*common._path(spark, at)) for at in seen[1]]
    assert there == [False, True] and out.count() == 2
    with pytest.raises(ValueError):
        common.operator(lambda df: (common.materialize(df), int("x")))(frame(spark, []))


def test_jobs_bound_the_rows_that_readers_hold(spark, tmp_path):
    """Texts of 4,096 rows, decoded into one array, and batches of megabytes were what executors of 3 GB ran out on."""
    names = (common._BATCHES, common._READ)
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(common._READ, "4096")
        seen = []
        common.operator(lambda df: seen.append(spark.conf.get(common._READ)))(spark.range(1))
        assert seen == ["512"] and spark.conf.get(common._READ) == "4096"
        spark.conf.unset(common._BATCHES)
        common.bound_batches(spark)
        assert [spark.conf.get(n) for n in names] == ["1m", "512"]
        spark.conf.set(common._READ, "100")  # the session's own bound stays
        common.bound_batches(spark)
        assert spark.conf.get(common._READ) == "100"
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
