"""Eight by eight grids of counts, and the measures of brightness on them: what pixels are to an image, words are to a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import let

SIDE = 8
CELLS = SIDE * SIDE


def document_tiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tile): cell k holds how many lower-case words of the text have an md5 whose first byte is k modulo 64."""
    word = F.explode(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), ""))
    cell = F.conv(F.substring(F.md5("_w"), 1, 2), 16, 10).cast("int") % CELLS
    n = docs.select(key, word.alias("_w")).groupBy(key, cell.alias("_c")).agg(F.count("*").alias("_n"))
    cells = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_n"))).alias("_m"))
    tile = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.coalesce(F.try_element_at(F.col("_m"), k), F.lit(0)).cast("double"))
    return docs.select(key).join(cells, key, "left").withColumn("_m", F.coalesce("_m", F.create_map().cast("map<int,bigint>"))).select(key, tile.alias("tile"))


def _moments(a):
    """n, sum and sum of squares; cells are counts, so the sums are exact."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return F.aggregate(a, start, lambda m, x: F.struct((m["s"] + x).alias("s"), (m["q"] + x * x).alias("q")))


def _variance(a):
    return let(a, lambda t: let(_moments(t), lambda m: (m["q"] - m["s"] * m["s"] / F.size(t)) / F.size(t)))


def tile_metrics(tiles: DataFrame, key: str, white: float = 8) -> DataFrame:
    """Mean, population deviation, share of cells of at least `white`, and entropy (bits) of the cells' values."""

    def metrics(t):
        each = F.transform(F.array_distinct(t), lambda v: F.size(F.filter(t, lambda x: x == v)) / F.size(t))
        entropy = F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))
        white_ratio = F.size(F.filter(t, lambda x: x >= white)) / F.size(t)
        return F.struct((_moments(t)["s"] / F.size(t)).alias("brightness"), F.sqrt(_variance(t)).alias("contrast"), white_ratio.alias("white_pixel_ratio"), (entropy + 0.0).alias("entropy"))

    names = ("brightness", "contrast", "white_pixel_ratio", "entropy")
    return tiles.select(key, let(F.col("tile"), metrics).alias("_m")).select(key, *[F.col(f"_m.{n}").alias(n) for n in names])


def tile_blur(tiles: DataFrame, key: str) -> DataFrame:
    """Population variance of the four-neighbour Laplacian; beyond the border the grid is mirrored at its outermost cells."""
    inner = lambda i: 1 if i < 0 else SIDE - 2 if i >= SIDE else i
    near = [[inner(r + i) * SIDE + inner(c + j) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))] for r in range(SIDE) for c in range(SIDE)]

    def laplacian(t):
        return F.array(*[sum((F.get(t, F.lit(i)) for i in four), F.lit(0.0)) - 4 * F.get(t, F.lit(k)) for k, four in enumerate(near)])

    return tiles.select(key, _variance(let(F.col("tile"), laplacian)).alias("blur_score"))
