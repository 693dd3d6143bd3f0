"""Native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a CSV reader in the style of data frames takes as missing; fixed by the accepted input format.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once however often body uses it: inside lambdas Spark computes an outer expression anew for each element."""
    return F.transform(F.array(value), body)[0]


def no_nan(c: Column) -> Column:
    """NaN counts as missing: one of them would spoil means, extremes and correlations."""
    return F.when(~F.isnan(c), c)


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_TOKENS), c)


def path_parts(relative: Column) -> Column:
    return F.split(relative, "/")


def folder_label(relative: Column) -> Column:
    """The folder next to the file; `unlabelled` for a file in the root."""
    p = path_parts(relative)
    return F.when(F.size(p) > 1, F.element_at(p, -2)).otherwise(F.lit("unlabelled"))


def folder_domain(relative: Column) -> Column:
    """The first folder, where there is one above the label's."""
    p = path_parts(relative)
    return F.when(F.size(p) > 2, F.element_at(p, 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def aspect_ratio(width: Column, height: Column) -> Column:
    """Four decimals, halves to even; null for a height of 0."""
    return F.when(height != 0, F.bround(width / F.nullif(height, F.lit(0)), 4))


def resolution_bucket(width: Column, height: Column) -> Column:
    size = F.concat(width.cast("bigint").cast("string"), F.lit("x"), height.cast("bigint").cast("string"))
    return F.coalesce(size, F.lit("unknown"))


def breed(image_id: Column) -> Column:
    """The id without its last underscore and what follows."""
    return F.regexp_replace(image_id, "_[^_]*$", "")


def species(code: Column) -> Column:
    return F.when(code == "1", "cat").otherwise("dog")


def split_name(is_trainval: Column, is_test: Column) -> Column:
    return F.when(is_trainval, "trainval").when(is_test, "test").otherwise("unknown")


def bits_to_long(bits: Column) -> Column:
    """64 cells of 0 or 1, the first the highest bit, as a signed 64-bit integer."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("bigint")))


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hash_bits(tile: Column) -> Column:
    """1 for each cell that reaches the mean of all."""
    mean = lambda t: F.aggregate(t, F.lit(0.0), lambda a, b: a + b) / F.size(t)
    return let(tile, lambda t: let(mean(t), lambda m: F.transform(t, lambda x: (x >= m).cast("int"))))


def difference_hash_bits(tile: Column, width: int = 9) -> Column:
    """For each row of `width` cells, 1 where the right neighbour is at least the left one."""

    def bits(t: Column) -> Column:
        cells = F.filter(F.sequence(F.lit(0), F.size(t) - 2), lambda i: i % width != width - 1)
        return F.transform(cells, lambda i: (F.get(t, i + 1) >= F.get(t, i)).cast("int"))

    return let(tile, bits)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def mean_of_present(*columns: Column) -> Column:
    """Mean of those that are not null; null if all are."""
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(n > 0, total / F.nullif(n, F.lit(0)))


def outlier_reason(isolation: Column, neighbours: Column, centroid: Column, flag_at: float = 0.8) -> Column:
    said = F.concat_ws(
        "; ",
        F.when(isolation >= flag_at, "quality features are unusual"),
        F.when(neighbours >= flag_at, "embedding is far from nearest neighbours"),
        F.when(centroid >= flag_at, "embedding is far from its class centroid"),
    )
    return F.when(said == "", "mildly unusual across detectors").otherwise(said)
