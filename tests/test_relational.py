from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensaudit import queries
from lensaudit.functions import columns as C
from lensaudit.operators import duplicates, isolation, projection, quantiles, relational, vectors


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"] if values else spark.range(1).select(expr.alias("x")).first()["x"]


def test_effects_match_the_theta_join(spark):
    rng = np.random.default_rng(0)
    rows = [("abc"[i % 3] if i % 11 else None, float(rng.normal(i % 3, 1)), float("nan") if i % 7 == 0 else float(i)) for i in range(300)]
    got = {(r["metric"], r["group_name"]): r for r in relational.effects(spark.createDataFrame(rows, "g string, a double, b double"), "g", ["a", "b"]).collect()}
    for m, k in (("a", 1), ("b", 2)):
        for g in "abc":
            x = np.array([r[k] for r in rows if r[0] == g and not math.isnan(r[k])])
            y = np.array([r[k] for r in rows if r[0] not in (g, None) and not math.isnan(r[k])])
            pooled = ((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / (len(x) + len(y) - 2)
            d = (x.mean() - y.mean()) / math.sqrt(max(pooled, 1e-8))
            r = got[m, g]
            assert (r["group_count"], r["suspicious_shortcut_signal"]) == (len(x), abs(d) >= 0.8)
            assert [r["mean_in_group"], r["mean_out_group"], r["cohens_d_vs_rest"]] == pytest.approx([x.mean(), y.mean(), d])


def test_effects_of_one_group_single_rows_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "g string, v double")
    r = relational.effects(df, "g", ["v"]).first()
    assert r["cohens_d_vs_rest"] == 0 and r["mean_out_group"] is None
    two = relational.effects(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double"), "g", ["v"]).collect()
    assert [x["cohens_d_vs_rest"] for x in two] == [0, 0]
    none = relational.effects(df.limit(0), "g", ["v"])
    assert none.count() == 0 and relational.suspicious([none, none]).count() == 0


def test_two_groups_have_opposite_effects(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i * i % 17)) for i in range(100)], "g string, v double")
    a, b = (r["cohens_d_vs_rest"] for r in relational.effects(df, "g", ["v"]).collect())
    assert a == pytest.approx(-b) and a != 0


def test_describe_histogram_boxplot_of_constants_and_nothing(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5 + [("a", None)], "g string, v double")
    d = {r["statistic"]: r["v"] for r in relational.describe(df, ["v"]).collect()}
    assert d["count"] == 5 and d["std"] == 0 and d["50%"] == 2
    bins = relational.histogram(df, "v").orderBy("bin").collect()
    assert len(bins) == 30 and sum(r["n"] for r in bins) == 5 and bins[0]["lo"] == 1.5 and bins[-1]["hi"] == 2.5
    assert relational.histogram(df.limit(0), "v").count() == 0
    assert relational.boxplot(df, "g", "v").first()["whisker_high"] == 2
    assert relational.correlation(df, ["v"]).first()["r"] is None
    assert relational.min_max(df, "v", "s").select("s").distinct().count() == 2
    assert {r["v"] for r in relational.standardise(df, ["v"]).collect()} == {0.0, None}


@pytest.mark.parametrize("held", [0, 40, 1 << 20])
def test_quartiles_by_ranges_against_sorted_values(spark, monkeypatch, held):
    rng = np.random.default_rng(3)
    groups = {
        "hot": (10 ** rng.normal(0, 12, 900)).tolist(), "ties": [1.0] * 50 + [2.0] * 49, "one": [7.0], "two": [-1.5, 1e300], "wide": [-1e308, 1e308, 0.0, 5.0, -5.0],
        "endless": [float("-inf"), 3.0, 4.0, float("inf"), float("inf"), *range(60)], "tiny": [5e-324 * i for i in range(70)],
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, v double").repartition(5)
    got = {r["g"]: r["_q"] for r in quantiles.quartiles(df, "g", "v", held).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        xs = sorted(map(float, xs))
        for p, q in zip(quantiles.QUARTILES, got[g], strict=True):
            at = p * (len(xs) - 1)
            low, high = xs[int(at)], xs[min(int(at) + 1, len(xs) - 1)]
            assert q == pytest.approx(low if at == int(at) or low == high else (int(at) + 1 - at) * low + (at - int(at)) * high, rel=1e-12)
    monkeypatch.setattr(quantiles, "HELD", held)
    some = df.where("g IN ('ties', 'one')").withColumn("w", F.lit(None).cast("double")).withColumn("n", F.when(F.col("g") == "one", float("nan")).otherwise(F.col("v")))
    d = {r["statistic"]: r for r in relational.describe(some, ["v", "w", "n"]).collect()}
    assert [d[s]["v"] for s in ("count", "25%", "50%", "75%", "max")] == [100, 1, 1.5, 2, 7] and d["50%"]["w"] is None and (d["count"]["n"], d["50%"]["n"]) == (99, 1)
    assert {r["g"]: (r["q1"], r["whisker_high"]) for r in relational.boxplot(some, "g", "n").collect()} == {"ties": (1, 2)}
    assert quantiles.quartiles(df.where("false"), "g", "v", held).count() == 0


def test_quartiles_of_values_of_all_sizes_in_eight_passes(spark, monkeypatch):
    passes, part = [], quantiles._part
    monkeypatch.setattr(quantiles, "_part", lambda: passes.append(1) or part())
    rng = np.random.default_rng(4)
    groups = {"positive": 10.0 ** rng.uniform(-300, 300, 3000), "both": 10.0 ** rng.uniform(-300, 300, 3000) * rng.choice([-1.0, 1.0], 3000), "close": 1 + np.arange(3000) * 2.0**-52, "denormal": np.append(np.arange(2999) * 5e-324, 1e308)}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs.tolist()], "g string, v double").repartition(3)
    got = {r["g"]: r["_q"] for r in quantiles.quartiles(df, "g", "v", held=100).collect()}
    assert len(passes) <= 8
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(xs, quantiles.QUARTILES).tolist(), rel=1e-9, abs=1e-323)


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.5, 1.0), (3.0, 5.0, 0.0), (4.0, None, 5.0), (5.0, 9.0, float("nan"))]
    got = {(r["x"], r["y"]): r["r"] for r in relational.correlation(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 3, 5], [2, 4.5, 5, 9])[0, 1])
    assert got["a", "c"] == pytest.approx(np.corrcoef([2, 3, 4], [1, 0, 5])[0, 1])


def test_contingency_has_zeros_and_no_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "x"), ("a", None)], "l string, d string")
    assert sorted(map(tuple, relational.contingency(df, "l", "d").collect())) == [("a", "x", 2), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)]
    assert [tuple(r) for r in relational.contingency_wide(df, "l", "d").collect()] == [("a", 2, 0), ("b", 0, 1)]


def test_domain_is_explicit_as_soon_as_one_row_has_one(spark):
    df = spark.createDataFrame([(None, "1x1"), ("s", "2x2")], "d string, b string")
    assert {tuple(r)[2:] for r in relational.infer_domain(df, "d", "b").collect()} == {("unknown", "explicit_source_domain"), ("s", "explicit_source_domain")}
    assert relational.infer_domain(df.where("d IS NULL"), "d", "b").first()["analysis_domain"] == "1x1"


@pytest.mark.parametrize("path, label, domain", [("img.png", "unlabelled", None), ("cat/img.png", "cat", None), ("s/cat/img.png", "cat", "s"), ("s/x/cat/i.png", "cat", "s")])
def test_folder_rules(spark, path, label, domain):
    assert one(spark, C.folder_label(F.col("p")), p=path) == label
    assert one(spark, C.folder_domain(F.col("p")), p=path) == domain


def test_small_expressions(spark):
    assert one(spark, C.aspect_ratio(F.lit(32), F.lit(1))) == 32.0 and one(spark, C.aspect_ratio(F.lit(1), F.lit(32))) == 0.0312
    assert one(spark, C.aspect_ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, C.resolution_bucket(F.lit(3), F.lit(4))) == "3x4" and one(spark, C.resolution_bucket(F.lit(3), F.lit(None))) == "unknown"
    assert one(spark, C.breed(F.lit("great_dane_12"))) == "great_dane" and one(spark, C.species(F.lit("1"))) == "cat"
    bits = F.array(*[F.lit(1)] * 64)
    assert one(spark, C.bits_to_long(bits)) == -1 and one(spark, C.hash_hex(C.bits_to_long(bits))) == "f" * 16
    assert one(spark, C.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64
    assert one(spark, C.mean_of_present(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0))) == 0.5
    assert one(spark, C.outlier_reason(F.lit(0.9), F.lit(None).cast("double"), F.lit(0.8))) == "quality features are unusual; embedding is far from its class centroid"
    assert one(spark, C.outlier_reason(F.lit(0.1), F.lit(0.1), F.lit(0.1))) == "mildly unusual across detectors"


def test_near_pairs_against_all_pairs_and_any_partitioning(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 12)
    rows = []
    for i in range(160):
        a, d = int(base[i % 12]), int(base[(i * 5) % 12])
        for _ in range(rng.integers(0, 5)):
            a ^= 1 << int(rng.integers(0, 48))
        a = a - (1 << 64) if a >= 1 << 63 else a
        rows.append((i, a, d, f"p{i}"))
    rows += [(200 + i, 0, 0, "flat") for i in range(30)] + [(300, None, 0, "none")]
    count = lambda x: bin(x & (2**64 - 1)).count("1")
    want = []
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if None not in (x[1], y[1]) and (x[1] >> 48) == (y[1] >> 48) and count(x[1] ^ y[1]) <= 6 and count(x[2] ^ y[2]) <= 6:
                want.append((x[0], y[0], x[3], y[3], count(x[1] ^ y[1]), count(x[2] ^ y[2])))
    df = spark.createDataFrame(rows, "i bigint, a bigint, d bigint, path string")
    for parts in (1, 8):
        assert sorted(map(tuple, duplicates.near_pairs(df.repartition(parts), "i", "a", "d", ["path"]).collect())) == sorted(want)
    assert duplicates.near_pairs(df, "i", "a", "d", prefix_bits=0).count() >= len(want)


def test_exact_groups_are_numbered_by_hash(spark):
    df = spark.createDataFrame([(1, "ff"), (2, "0a"), (3, "ff"), (4, "0a"), (5, "b0"), (6, None), (7, None)], "i int, h string")
    assert sorted(map(tuple, duplicates.exact_groups(df, "h", ["i"]).collect())) == [(1, "0a", 2), (1, "0a", 4), (2, "ff", 1), (2, "ff", 3)]


def test_neighbours_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(70, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "i bigint, v array<double>")
    want = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, 5]
    for block in (4096, 16):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {r["i"]: r["knn_distance"] for r in vectors.knn_distance(df, "i", "v").collect()}
        assert [got[i] for i in range(70)] == pytest.approx(want) and 99 not in got
    few = {r["i"]: r["knn_distance"] for r in vectors.knn_distance(df.where("i < 2"), "i", "v").collect()}
    assert few[0] == pytest.approx(np.linalg.norm(x[0] - x[1]))


def test_null_labels_have_no_centroid_score(spark):
    df = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", [2.0, 0.0]), (3, None, [5.0, 5.0])], "i bigint, l string, v array<double>")
    got = {r["i"]: r["centroid_distance"] for r in vectors.centroid_distance(df, "l", "v").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None}
    scored = vectors.combine_scores(spark.createDataFrame([(None, 1.0, 0.0), (None, 3.0, None)], "a double, b double, c double"), "a", "b", "c").collect()
    assert [r["outlier_score"] for r in scored] == [0.0, 1.0]


def test_isolation_ranks_a_far_row_first_and_ignores_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000, 9.0, -9.0), (1001, None, 0.0)]
    df = spark.createDataFrame(rows, "i bigint, a double, b double")
    one, eight = ({r["i"]: r["isolation"] for r in isolation.isolation_scores(df.repartition(n), "i", ["a", "b"]).collect()} for n in (1, 8))
    assert one == pytest.approx(eight) and max(one, key=one.get) == 1000 and 1001 not in one
    assert all(0 < s < 1 for s in one.values())
    assert isolation.isolation_scores(df.limit(0), "i", ["a", "b"]).count() == 0


def test_projections(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) * [5, 2, 0.1, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, v array<double>")
    got = np.array([[r["pca_x"], r["pca_y"]] for r in projection.pca(df, "i", "v").orderBy("i").collect()])
    _, s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs((x - x.mean(0)) @ axes[:2].T))
    assert projection.principal_axes(df, "v")[2].sum() > 0.99
    assert projection.pca(df.limit(1), "i", "v").first()["pca_x"] is None
    assert projection.tsne(df.limit(4), "i", "v").first()["tsne_x"] is None
    two = np.concatenate((rng.normal(size=(40, 3)), rng.normal(size=(40, 3)) + 30))
    y = projection.tsne_layout(two, 10, steps=300)
    near = np.linalg.norm(y[:, None] - y[None], axis=2).argsort(1)[:, 1:4]
    assert ((near < 40) == (np.arange(80) < 40)[:, None]).mean() > 0.95


def test_tsne_gives_every_row_coordinates(spark):
    """Beyond the fitted rows: null before, now among the fitted rows of the same group."""
    rng = np.random.default_rng(7)
    group = np.arange(160) % 4
    x = rng.normal(size=(160, 5)) + 40 * np.eye(4, 5)[group]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, v array<double>")
    rows = projection.tsne(df.repartition(3), "i", "v", most=60).orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(160)) and all(r["tsne_x"] is not None and r["tsne_y"] is not None for r in rows)
    y = np.array([[r["tsne_x"], r["tsne_y"]] for r in rows])
    near = np.linalg.norm(y[:, None] - y[None], axis=2).argsort(1)[:, 1:4]
    assert (group[near] == group[:, None]).mean() > 0.95
    fitted = rng.normal(size=(20, 3))
    assert projection.place(fitted + 1e-9, fitted, np.arange(40.0).reshape(20, 2)).shape == (20, 2)
    assert np.isfinite(projection.place(np.zeros((2, 3)), np.zeros((20, 3)), np.ones((20, 2)))).all()


def test_tsne_query_lays_out_more_than_500_rows(spark):
    got = queries.tsne_projection(spark, "/root/testdata/sf0.1").agg(F.count("*"), F.count("tsne_x")).first()
    assert tuple(got) == (2000, 2000)


def test_names_of_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "x", "1x1", 2.0, "ab"), (2, None, "2x2", 4.0, "ab")], "cluster_id int, _any string, _lo string, _hi double, _hash string")
    assert {r["score"] for r in relational.min_max(df, "_hi", "score").collect()} == {0.0, 1.0}
    assert [r["analysis_domain"] for r in relational.infer_domain(df, "_any", "_lo").orderBy("cluster_id").collect()] == ["x", "unknown"]
    got = duplicates.exact_groups(df, "_hash", ["_any", "_lo"]).collect()
    assert [r["cluster_id"] for r in got] == [1, 1] and {r["_lo"] for r in got} == {"1x1", "2x2"}


def test_ranks_of_many_keys(spark):
    keys = sorted({f"{i * 2654435761 % 2**32:08x}" for i in range(500)})
    got = {r["k"]: r["rank"] for r in relational.distinct_rank(spark.createDataFrame([(k,) for k in keys * 2] + [(None,)], "k string"), "k", "rank").collect()}
    assert got == {k: i + 1 for i, k in enumerate(keys)}


def test_near_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        a, d = (int(x) for x in rng.integers(-(2**63), 2**63, 2)) if i % 6 == 0 else rows[-1][1:]
        for _ in range(int(rng.integers(0, 4))):
            a ^= 1 << int(rng.integers(0, 40))
            d ^= 1 << int(rng.integers(0, 63))
        rows.append((i, a, d))
    apart = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and (x[1] >> 48) == (y[1] >> 48) and apart(x[1], y[1]) <= 6 and apart(x[2], y[2]) <= 6}
    got = [(r["left_index"], r["right_index"]) for r in duplicates.near_pairs(spark.createDataFrame(rows, "i int, a bigint, d bigint"), "i", "a", "d").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_unsound_vectors_have_no_place(spark):
    rows = [(i, "a", [float(i), float(i * i % 7), 1.0]) for i in range(8)] + [(20, "a", None), (21, "a", [1.0, None, 2.0]), (22, "a", [1.0, 2.0]), (23, "a", [float("nan")] * 3), (24, "a", [])]
    df = spark.createDataFrame(rows, "i bigint, l string, v array<double>")
    for found, column in ((projection.pca(df, "i", "v"), "pca_x"), (projection.tsne(df, "i", "v"), "tsne_x"), (vectors.knn_distance(df, "i", "v"), "knn_distance")):
        got = {r["i"]: r[column] for r in found.collect()}
        assert {i for i, x in got.items() if x is None} == {21, 22, 23, 24} and len(got) == 12
    x = np.array([r[2] for r in rows[:8]])
    values, axes = np.linalg.eigh(np.cov(x.T))
    best = (x - x.mean(0)) @ axes[:, ::-1][:, :2]
    got = np.array([[r["pca_x"], r["pca_y"]] for r in projection.pca(df, "i", "v").where("i < 20").orderBy("i").collect()])
    assert np.allclose(np.abs(got), np.abs(best), atol=1e-8)


def test_wide_tables_have_a_bound(spark, monkeypatch):
    df = spark.createDataFrame([("a", f"c{i}") for i in range(9)], "l string, d string")
    assert len(relational.contingency_wide(df, "l", "d").columns) == 10
    monkeypatch.setattr(relational, "WIDEST", 5)
    assert relational.contingency_wide(df, "l", "d").columns == ["l", "d", "n"]
