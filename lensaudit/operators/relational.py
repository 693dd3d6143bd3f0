"""Counts, summaries, effects, contingency tables, extremes, histograms: all native plans.

Aggregates combine before they shuffle; tables of one row are joined by broadcast; nothing orders a whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles

#: Columns of a contingency table up to which it is written as a wide one.
WIDEST = 1000


def counts(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Rows of each non-null key, most first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)


def class_balance(df: DataFrame, key: str) -> DataFrame:
    """Counts with their share of all counted rows."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"))
    total = per.agg(F.sum("count").alias("_total"))
    return per.crossJoin(F.broadcast(total)).select(key, "count", (F.col("count") / F.greatest(F.col("_total"), F.lit(1))).alias("fraction")).orderBy(F.desc("count"), key)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).where("count > 1").orderBy(F.desc("count"), key)


def totals(df: DataFrame, label: str, readable: Column, domain: str | None = None) -> DataFrame:
    """One row: rows, readable and unreadable ones, classes among the readable, whether any domain is given."""
    any_domain = F.coalesce(F.bool_or(F.col(domain).isNotNull()), F.lit(False)) if domain else F.lit(False)
    good = F.coalesce(readable, F.lit(False))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(good).alias("n_readable"), F.count_if(~good).alias("n_unreadable"), F.count_distinct(F.when(good, F.col(label))).alias("n_classes"), any_domain.alias("has_domain")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows count, mean, std (sample), min, 25%, 50%, 75% (interpolated), max; a column for each measure. Long columns have their quartiles found by ranges of values."""
    present = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    most = max(df.agg(*[F.count(x).alias(f"_{i}") for i, x in enumerate(present)]).first() or [0], default=0)
    ranged = {}
    if most > quantiles.HELD:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), x.alias("_x")) for i, x in enumerate(present)])).alias("_r")).select("_r.*").where("_x IS NOT NULL")
        ranged = {r["_i"]: r["_q"] for r in quantiles.quartiles(long, "_i", "_x").collect()}
    aggs = []
    for i, x in enumerate(present):
        held = F.percentile(x, F.array(*map(F.lit, quantiles.QUARTILES)))
        quartiles = (F.array(*map(F.lit, ranged[i])) if i in ranged else F.lit(None).cast("array<double>")) if most > quantiles.HELD else held
        aggs.append(F.struct(F.count(x).cast("double").alias("a"), F.avg(x).alias("b"), F.stddev_samp(x).alias("c"), F.min(x).alias("d"), quartiles.alias("q"), F.max(x).alias("e")).alias(f"_{i}"))
    one = df.agg(*aggs)
    names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    part = lambda i, k: {0: f"_{i}.a", 1: f"_{i}.b", 2: f"_{i}.c", 3: f"_{i}.d", 4: f"_{i}.q[0]", 5: f"_{i}.q[1]", 6: f"_{i}.q[2]", 7: f"_{i}.e"}[k]
    rows = [F.struct(F.lit(n).alias("statistic"), *[F.expr(part(i, k)).alias(c) for i, c in enumerate(columns)]) for k, n in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def extremes(df: DataFrame, metric: str, k: int, tie: str, lowest: bool = True, columns: Sequence[str] = ()) -> DataFrame:
    """The k rows of least or greatest metric, ties by key: a top-k heap in each task, no full sort."""
    rows = df.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double"))).select(tie, *columns, metric)
    return rows.orderBy(F.col(metric).asc() if lowest else F.col(metric).desc(), tie).limit(k)


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of all pairs (x, y, r), over rows where both are present; null where one is constant. One pass."""
    aggs, names = [], []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i:], i):
            x, y = (F.col(c).cast("double") for c in (a, b))
            both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
            x, y = F.when(both, x), F.when(both, y)
            aggs.append(F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))).alias(f"_{i}_{j}"))
            names.append((i, j))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.col(f"_{min(i, j)}_{max(i, j)}").alias("r")) for i in range(len(columns)) for j in range(len(columns))]
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def histogram(df: DataFrame, metric: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n) of equal widths from least to greatest, the last closed; a constant has the range half a unit around it."""
    x = F.col(metric).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("_x"))
    ends = rows.agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    ends = ends.where(F.col("_a").isNotNull()).select(F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"), F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"))
    at = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    n = rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return every.join(F.broadcast(n), "bin", "left").select("bin", (F.col("_lo") + width * F.col("bin")).alias("lo"), (F.col("_lo") + width * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def boxplot(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Quartiles of each key, and the outermost values within 1.5 times their distance. No key's values are gathered beyond quantiles.HELD."""
    x = F.col(metric).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & F.col(key).isNotNull()).select(key, x.alias("_x"))
    q = quantiles.quartiles(rows, key, "_x").select(key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(q, key).where((F.col("_x") >= F.col("q1") - reach) & (F.col("_x") <= F.col("q3") + reach))
    return inside.groupBy(key, "q1", "median", "q3").agg(F.min("_x").alias("whisker_low"), F.max("_x").alias("whisker_high")).orderBy(key)


def effects(df: DataFrame, group: str, metrics: Sequence[str], group_type: str | None = None, large: float = 0.8, least_n: int = 10) -> DataFrame:
    """Each group against all other rows, by metric: sizes, means, Cohen's d, and whether it is large.

    The theta join (group <> other) isn't made, and rows are read once: each group's size, mean and squares around it are merged to those of
    all rows, and the rest is all less the group. Null groups and metrics don't count.
    """
    names = [F.struct(F.lit(m).alias("metric"), F.lit(i).alias("_order"), F.col(m).cast("double").alias("_v")) for i, m in enumerate(metrics)]
    long = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("group_name"), F.explode(F.array(*names)).alias("_m")).select("group_name", "_m.*")
    long = long.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    per = long.groupBy("metric", "_order", "group_name").agg(F.count("*").alias("n_g"), F.avg("_v").alias("m_g"), (F.var_pop("_v") * F.count("*")).alias("q_g"))
    whole = per.groupBy("metric").agg(F.sum("n_g").alias("n_t"), (F.sum(F.col("n_g") * F.col("m_g")) / F.sum("n_g")).alias("m_t"))
    x = per.join(whole, "metric").withColumn("q_g_t", F.col("q_g") + F.col("n_g") * (F.col("m_g") - F.col("m_t")) * (F.col("m_g") - F.col("m_t")))
    x = x.join(x.groupBy("metric").agg(F.sum("q_g_t").alias("q_t")), "metric").withColumn("n_o", F.col("n_t") - F.col("n_g"))
    some = F.nullif(F.col("n_o"), F.lit(0))
    off = F.col("n_g") * (F.col("m_t") - F.col("m_g")) / some  # how far the rest's mean is from that of all
    m2 = F.col("q_g") + F.greatest(F.col("q_t") - F.col("q_g_t") - F.coalesce(off * off * F.col("n_o"), F.lit(0.0)), F.lit(0.0))
    pooled = m2 / F.greatest(F.col("n_t") - 2, F.lit(1))
    d = F.when((F.col("n_g") < 2) | (F.col("n_o") < 2), 0.0).otherwise((F.col("m_g") - F.col("m_t") - off) / F.sqrt(F.greatest(pooled, F.lit(1e-8))))
    out = x.select(
        F.lit(group_type or group).alias("group_type"), "group_name", "metric", F.col("n_g").alias("group_count"), F.col("m_g").alias("mean_in_group"),
        (F.col("m_t") + off).alias("mean_out_group"), d.alias("cohens_d_vs_rest"), "_order",
    )
    out = out.withColumn("suspicious_shortcut_signal", (F.abs("cohens_d_vs_rest") >= large) & (F.col("group_count") >= least_n))
    return out.orderBy("_order", "group_name").drop("_order")


def suspicious(tables: Sequence[DataFrame]) -> DataFrame:
    """Flagged effects of all tables, the strongest first."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.where("suspicious_shortcut_signal").orderBy(F.abs("cohens_d_vs_rest").desc(), "group_type", "group_name", "metric")


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) for all pairs of keys that occur, zeros included; pairs with a null don't count."""
    rows = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    n = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    every = n.select(row).distinct().crossJoin(n.select(column).distinct())
    return every.join(n, [row, column], "left").select(row, column, F.coalesce("n", F.lit(0)).alias("n"))


def contingency_wide(df: DataFrame, row: str, column: str) -> DataFrame:
    """A column for each value of `column`, for the CSV of an export; with more than WIDEST values the long form of contingency()."""
    rows = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    values = [r[0] for r in rows.select(column).distinct().limit(WIDEST + 1).collect()]
    if len(values) > WIDEST:
        return contingency(df, row, column).orderBy(row, column)
    return rows.groupBy(row).pivot(column, sorted(values)).count().na.fill(0).orderBy(row)


def infer_domain(df: DataFrame, explicit: str, bucket: str) -> DataFrame:
    """Adds analysis_domain and its kind: the explicit domain if any row has one, else the resolution bucket."""
    any_ = df.agg(F.coalesce(F.bool_or(F.col(explicit).isNotNull()), F.lit(False)).alias("_any"))
    row = lambda c: F.col(f"_row.`{c}`")
    chosen = F.when(F.col("_any"), F.coalesce(row(explicit).cast("string"), F.lit("unknown"))).otherwise(row(bucket))
    kind = F.when(F.col("_any"), "explicit_source_domain").otherwise("inferred_resolution_bucket")
    return _carried(df, any_, {"analysis_domain": chosen, "analysis_domain_kind": kind})


def _carried(df: DataFrame, one: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with new columns, which may use those of the one-row table `one`; rows are carried as a struct (_row), so that no name of theirs can clash."""
    both = df.select(F.struct("*").alias("_row")).crossJoin(F.broadcast(one))
    return both.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in new], *[c.alias(name) for name, c in new.items()])


def membership(df: DataFrame, key: str, sets: dict[str, DataFrame]) -> DataFrame:
    """A boolean column for each set of ids (its first column), true where the key is in it; it takes the place of a column of df with its name."""
    rows = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"))
    for i, ids in enumerate(sets.values()):
        rows = rows.join(ids.select(F.col(f"`{ids.columns[0]}`").alias(f"_id_{i}")).where(F.col(f"_id_{i}").isNotNull()).distinct(), F.col("_key") == F.col(f"_id_{i}"), "left")
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in sets], *[F.col(f"_id_{i}").isNotNull().alias(name) for i, name in enumerate(sets)])


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1; a constant column to 0."""
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = {c: (F.col(f"_row.`{c}`") - F.col(f"_m_{i}")) / F.when(F.col(f"_s_{i}") > 1e-12 * F.greatest(F.abs(f"_m_{i}"), F.lit(1.0)), F.col(f"_s_{i}")).otherwise(1.0) for i, c in enumerate(columns)}
    both = df.select(F.struct("*").alias("_row")).crossJoin(F.broadcast(one))
    return both.select(*[(out[c] if c in out else F.col(f"_row.`{c}`")).alias(c) for c in df.columns])


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """column scaled to 0..1 as out; 0 throughout where its range is next to nothing."""
    return min_max_all(df, {column: out})


def min_max_all(df: DataFrame, outs: dict[str, str]) -> DataFrame:
    """min_max() of several columns (column to out), whose ranges come from one aggregate."""
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{i}") for i, c in enumerate(outs) for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(i: int, column: str) -> Column:
        x, lo, hi = F.col(f"_row.`{column}`").cast("double"), F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        flat = F.abs(hi - lo) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(lo)
        return F.when(x.isNull(), F.lit(None)).when(flat, 0.0).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))

    return _carried(df, one, {out: scaled(i, c) for i, (c, out) in enumerate(outs.items())})


def distinct_rank(df: DataFrame, key: str, out: str, prefix: int = 3) -> DataFrame:
    """(key, 1-based rank) of each distinct non-null string key. A window runs over the keys of one beginning (as evenly spread as those of hashes), and beginnings are summed up."""
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.substring(key, 1, prefix).alias("_part")).distinct()
    sizes = keys.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = keys.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy("_key"))).join(before, "_part")
    return ranked.select(F.col("_key").alias(key), (F.col("_before") + F.col("_place")).alias(out))
