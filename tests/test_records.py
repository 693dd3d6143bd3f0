from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lensaudit.plans import audit
from lensaudit.sources import files, records


@pytest.mark.parametrize("partitions", [1, 8])
def test_row_numbers_follow_the_order(spark, partitions):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("key"), F.lit("x").alias("_row"), F.lit(None).cast("string").alias("a b"), F.lit(1).alias("_part")).repartition(partitions)
    with_aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = records.with_row_index(df.orderBy("key"))
        assert out.columns == ["row_index", *df.columns]
        for _ in range(2):  # a second run reads the written table again
            assert [(r["row_index"], r["key"]) for r in out.orderBy("row_index").collect()] == [(i, i) for i in range(1000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_aqe)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_row_numbers_of_ties_random_order_empty_partitions_and_nothing(spark):
    ties = spark.range(600).select(F.lit(1).alias("k"), "id").repartition(8).orderBy("k")
    assert sorted(r["n"] for r in records.with_row_index(ties, "n").collect()) == list(range(600))
    mixed = records.with_row_index(spark.range(500).orderBy(F.rand()))
    first = {tuple(r) for r in mixed.collect()}
    assert {tuple(r) for r in mixed.collect()} == first and {n for n, _ in first} == set(range(500))  # a sort that no two runs repeat
    gaps = spark.range(0, 100, 1, 10).where("id BETWEEN 15 AND 17 OR id = 88")
    assert [tuple(r) for r in records.with_row_index(gaps).orderBy("id").collect()] == [(0, 15), (1, 16), (2, 17), (3, 88)]
    assert records.with_row_index(spark.range(0)).collect() == []


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_one_csv_of_many_ordered_parts(spark, tmp_path, scheme):
    """The bytes that one task would write."""
    out = audit.Outputs(spark, f"{scheme}{tmp_path}/made")
    df = spark.range(0, 3000, 1, 7).select(F.col("id").alias('odd "name", x'), F.concat(F.lit('a,"'), F.col("id"), F.lit("\n")).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("")).alias(" none ")).orderBy(F.desc('odd "name", x'))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out.csv("t.csv", df)
        df.write.option("header", False).csv(f"{tmp_path}/parts")
        assert len(list((tmp_path / "parts").glob("part-*"))) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/one")
    assert (tmp_path / "made" / "t.csv").read_bytes() == next((tmp_path / "one").glob("part-*")).read_bytes()
    assert [p.name for p in (tmp_path / "made").iterdir() if not p.name.startswith(".")] == ["t.csv"]
    out.csv("t.csv", spark.range(2))
    out.csv("none.csv", df.limit(0))
    assert (tmp_path / "made" / "t.csv").read_text() == "id\n0\n1\n" and (tmp_path / "made" / "none.csv").read_text().count("\n") == 1


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_parts_are_joined_by_the_number_of_their_task(spark, tmp_path, scheme):
    folder = tmp_path / "x.parts"
    folder.mkdir()
    for n in (99999, 100000, 100001, 0, 10000):
        (folder / f"part-{n:05d}-id-c000.csv").write_text(f"{n}\n")
    (folder / "part-00000-id-c001.csv").write_text("0b\n")
    (folder / "_SUCCESS").write_text("")
    files.join_parts(spark, f"{scheme}{folder}", f"{scheme}{tmp_path}/x", b"h\n")
    assert (tmp_path / "x").read_text().split() == ["h", "0", "0b", "10000", "99999", "100000", "100001"] and not folder.exists()
