"""Mixing sources to target weights by capped water-filling.

Sources are a table too, a row each, however many there are: the driver gets their number and the water level. A source's
fractional repetition goes to the documents whose seeded draws are least, up to the prefix nearest to the words it lacks: the
cut is narrowed by two passes of 1024 aggregated ranges, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, operator, text_of

#: Sources up to which their table is broadcast; beyond it joins shuffle, a source's rows in SALTS parts.
BROADCAST_SOURCES, SALTS = 20_000, 8
#: Bits of a draw, and of each of the two ranges that narrow its cut.
_BITS, _RANGE = 60, 10
_KEY = ["_none", "_source"]


def by_threes(place: Column) -> Column:
    """Weights 1, 2, 3, repeating, for places from 0."""
    return F.lit(1.0) + place % 3


def repeating(n: int) -> list[float]:
    return [1.0 + i % 3 for i in range(n)]


def water_fill(sizes: Sequence[int], weights: Sequence[float], epochs: float) -> list[float]:
    """Of sources in a list; fill() is the same for a table. Targets that share the sum of all sizes by weight, none above epochs times its size while others have room."""
    capped: set[int] = set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(weights[i] for i in open_)
        level = (sum(sizes) - sum(epochs * sizes[i] for i in capped)) / weight if weight > 0 else 0.0
        over = [i for i in open_ if weights[i] * level > epochs * sizes[i]]
        if not over:
            return [float(epochs * sizes[i]) if i in capped else weights[i] * level for i in range(len(sizes))]
        capped.update(over)


def word_count(text_column: str = "text") -> Column:
    return F.regexp_count(text_of(text_column), F.lit("[^" + SPACE_CLASS[1:] + "+")).cast("bigint")


def draw(ident: Column, seed: int) -> Column:
    """60 bits from the id and the seed, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))), 1, _BITS // 4), 16, 10).cast("bigint")


def _keyed(docs: DataFrame, id_column: str, source_column: str, text_column: str, seed: int) -> DataFrame:
    source = F.col(source_column).cast("string")
    return docs.select(
        F.struct("*").alias("_row"), source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source"), word_count(text_column).alias("size"),
        draw(F.col(id_column), seed).alias("_draw"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_id"),
    )


def _in_order(sources: DataFrame, *order: str) -> DataFrame:
    """Sources written in an order, with the partition (_range_of) of the sort that each is in."""
    return materialize(sources.orderBy(*order).withColumn("_range_of", F.spark_partition_id()))


def _so_far(placed: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over all rows before each one: windows run within the partitions of _in_order(), whose totals, a row a partition, are added up and sent to all."""
    per = placed.groupBy("_range_of").agg(*[F.sum(c).alias(f"_in_{n}") for n, c in sums.items()])
    ahead = Window.orderBy("_range_of").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_range_of", *[F.coalesce(F.sum(f"_in_{n}").over(ahead), F.lit(0)).alias(f"_to_{n}") for n in sums])
    within = Window.partitionBy("_range_of").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(before), "_range_of").withColumns({n: F.col(f"_to_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})


def fill(totals: DataFrame, epochs: float, weights: Callable[[Column], Column]) -> DataFrame:
    """Sources (_none, _source, source_size) with their target, as water_fill() gives it: weights by place in code-point order, null last.

    In the order of size over weight, sources are full up to the first one at which what is left, shared among it and all after it, needs no more than it has.
    """
    placed = _so_far(_in_order(totals, *_KEY), _KEY, {"_place": F.lit(1)})
    weighed = placed.select(*_KEY, "source_size", (F.lit(float(epochs)) * F.col("source_size")).alias("_room"), weights(F.col("_place")).cast("double").alias("_weight"))
    placed = _in_order(weighed.withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("_room") / F.col("_weight")).otherwise(float("inf"))), "_ratio", *_KEY)
    whole = placed.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weight")).first()
    left = F.lit(float(whole["weight"] or 0)) - F.col("_passed")
    at = _so_far(placed, ["_ratio", *_KEY], {"_full": F.col("_room"), "_passed": F.col("_weight")}).where(left > 0)
    at = at.withColumn("_level", (F.lit(float(whole["words"] or 0)) - F.col("_full")) / left).where("_level <= _ratio")
    level = at.agg(F.min_by("_level", F.struct("_ratio", *_KEY))).first()[0]
    target = F.col("_room") if level is None else F.least("_room", F.col("_weight") * F.lit(level))
    return placed.select(*_KEY, "source_size", F.when(F.col("_weight") > 0, target).otherwise(0.0).alias("target"))


def _with(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with what the plan has for their source: sent to all tasks if its counted rows allow, so that a hot source's rows stay where they are; else in SALTS parts a source."""
    if few:
        return rows.join(F.broadcast(plan), _KEY)
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod("_draw", F.lit(SALTS)).cast("int")).join(salted, [*_KEY, "_salt"]).drop("_salt")


def _narrowed(rows: DataFrame, plan: DataFrame, few: bool, shift: int) -> DataFrame:
    """The plan with the range of draws in which the words so far reach what a source lacks, and the words before that range."""
    inside = _with(rows, plan, few).where((F.col("_draw") >= F.col("_low")) & (F.col("_draw") <= F.col("_high")))
    sums = inside.groupBy(*_KEY, F.shiftright("_draw", shift).alias("_range"), "_before", "_part").agg(F.sum("size").alias("_words"))
    so_far = sums.withColumn("_end", F.col("_before") + F.sum("_words").over(Window.partitionBy(*_KEY).orderBy("_range")))
    first = so_far.where("_end >= _part").groupBy(*_KEY).agg(F.min(F.struct("_range", (F.col("_end") - F.col("_words")).alias("_start"))).alias("_x"))
    low = F.shiftleft("_x._range", shift)
    new = {"_low": F.coalesce(low, F.col("_low")), "_high": F.coalesce(low + ((1 << shift) - 1), F.col("_high")), "_before": F.coalesce("_x._start", F.col("_before"))}
    return materialize(plan.join(first, _KEY, "left").withColumns(new).drop("_x"))


def plan_mix(rows: DataFrame, epochs: float, weights: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """One row a source of rows (_none, _source, size, _draw, _id): size, target, whole repetitions, last draw and id of one repetition more; and whether there are few."""
    filled = fill(rows.groupBy(*_KEY).agg(F.sum("size").alias("source_size")), epochs, weights)
    few = filled.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = filled.withColumn("_whole", whole).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = plan.withColumns({"_low": F.lit(0).cast("bigint"), "_high": F.lit((1 << _BITS) - 1), "_before": F.lit(0).cast("bigint")})
    for level in (1, 2):
        plan = _narrowed(rows, plan, few, _BITS - level * _RANGE)
    last = _with(rows, plan, few).where((F.col("_draw") >= F.col("_low")) & (F.col("_draw") <= F.col("_high")))
    last = last.groupBy(*_KEY, "_draw", "_id", "_before", "_part").agg(F.sum("size").alias("size"))
    ends = last.withColumn("_end", F.col("_before") + F.sum("size").over(Window.partitionBy(*_KEY).orderBy("_draw", "_id").rowsBetween(Window.unboundedPreceding, 0)))
    taken = ends.where("2 * _end - size < 2 * _part").groupBy(*_KEY).agg(F.max(F.struct("_draw", "_id")).alias("_x"))
    cut = {"_cut": F.coalesce("_x._draw", F.col("_low") - 1), "_cut_id": F.coalesce("_x._id", F.lit(""))}
    return materialize(plan.join(taken, _KEY, "left").withColumns(cut).select(*_KEY, "source_size", "target", "_whole", "_cut", "_cut_id")), few


def _repeats() -> Column:
    extra = (F.col("_draw") < F.col("_cut")) | ((F.col("_draw") == F.col("_cut")) & (F.col("_id") <= F.col("_cut_id")))
    return F.col("_whole") + F.when(extra, 1).otherwise(0)


@operator
def mix_counts(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", epochs: float = 3, weights: Callable[[Column], Column] = by_threes, seed: int = 7) -> DataFrame:
    """One row a document: its id, size (words; null text: 0), source_size, target (its source's), taken (words, repeats counted).

    weights makes a source's weight of its place, from 0, in code-point order, null last. Each document is taken whole times or
    once more, so never above epochs times its size, as long as epochs is whole; a source's taken words miss its target by half a document at most.
    Rows that repeat an id have the same draw and go together, as one document. Ids may be of any type; a null id draws as the empty text. Texts of any
    length are counted whole. A source
    without words has the target 0. An empty table gives an empty result; other columns are not looked at.
    """
    rows = _keyed(docs.select(id_column, source_column, text_column), id_column, source_column, text_column, seed)
    rows = materialize(rows.select(F.col(f"_row.{id_column}").alias("_ident"), "_none", "_source", "size", "_draw", "_id"))
    out = _with(rows, *plan_mix(rows, epochs, weights))
    return out.select(F.col("_ident").alias(id_column), "size", "source_size", "target", (F.col("size") * _repeats()).alias("taken"))


@operator
def mix_documents(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", epochs: float = 3, weights: Callable[[Column], Column] = by_threes, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as mix_counts() takes it, columns as they are, extra ones of any name too; repeated rows each so often.

    Nulls, ids, long texts, ties and empty tables as in mix_counts().
    """
    sized = materialize(_keyed(docs.select(id_column, source_column, text_column), id_column, source_column, text_column, seed).drop("_row"))
    rows = _with(_keyed(docs, id_column, source_column, text_column, seed), *plan_mix(sized, epochs, weights))
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), _repeats().cast("int"))).alias("_time")).select("_row.*")
