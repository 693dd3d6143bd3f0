"""Near-duplicates by word shingles: universal-hash minima, banding, signature check, exact check, components.

Documents with one and the same shingle set are one class from the start, so a hot group of exact copies is one row. What makes a class is a
cryptographic digest of the full sorted set. Within a bucket every class is compared with the bucket's hub only. Classes that this leaves in different
components, though they share a bucket, are joined on their rarest shingles: two sets that are alike enough must share one of a fifth of
their shingles, taken in any one order, and in the order of frequency passages that many documents share come last. Classes that meet there are compared
in blocks inside tasks, signatures first and full sets then, and one confirmed link for a class and component leaves a task. All classes that share one of
their rarest shingles are looked at, so no component is split that a link between different texts joins, and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen_rows, discard, materialize, mix, operator, sequence_hashes, sequence_sums, slabs, span_hashes, splittable, text_of, word_spans
from .components import components

#: 32 bands of 5: a pair at 0.8 is missed with probability 3e-6.
BANDS, ROWS = 32, 5
#: What the share of equal minima may fall short of the threshold before the exact check; five standard deviations.
MARGIN = 0.16
#: Bits of a shingle's hash by which its frequency is counted, only to order shingles.
COUNTED_BITS = 18
#: Classes, and shingles, in a block of the second search; sets that are checked at once.
BLOCK, BLOCK_ITEMS, AT_ONCE = 512, 1 << 22, 64

_RNG = np.random.Generator(np.random.PCG64(97))
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and where each row begins (rows + 1).

    A row of fewer than k words, but at least one, has its whole sequence as the one shingle.
    """
    begin, end, first = word_spans(data, offs)
    words = span_hashes(data, begin, end, lower=True)
    sums = sequence_sums(words)
    n = np.diff(first)
    sets, at = [], np.zeros(len(n) + 1, np.int64)
    every = sequence_hashes(sums, np.arange(max(len(words) - k + 1, 0)), k)
    for i, m in enumerate(n):
        if m >= k:
            own = np.sort(every[first[i] : first[i + 1] - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif m:
            own = sequence_hashes(sums, first[i : i + 1], m)
        else:
            own = every[:0]
        sets.append(own)
        at[i + 1] = at[i] + len(own)
    return (np.concatenate(sets) if sets else every), at


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slabs(batch.column(1), 1 << 19):
                items, at = shingle_sets(data, offs, k)
                size = np.diff(at)
                some = np.flatnonzero(size)
                minima = np.zeros((hi - lo, BANDS * ROWS), np.uint16)
                if len(some):
                    starts = at[:-1][some]
                    for j in range(BANDS * ROWS):
                        least = np.minimum.reduceat(items * _A[j] + _B[j], starts)
                        minima[some, j] = mix(least) >> np.uint64(48)
                signs = pa.array([x.tobytes() for x in minima], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), _digests(items, at), signs], ["ident", "n_shingles", "digest", "signature"])

    return run


def _digests(items: np.ndarray, at: np.ndarray) -> pa.Array:
    """A digest of 128 bits for each full sorted set."""
    return pa.array([blake2b(items[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())


def _sets(k: int):
    """Rows (carried, text) to (carried, digest, items): the sorted set of shingles, and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slabs(batch.column(1), 1 << 19):
                items, at = shingle_sets(data, offs, k)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _digests(items, at), lists], ["carried", "digest", "items"])

    return run


def _alike(threshold: float):
    """Rows (u, v, signatures) whose signatures agree well enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            good = (a == b).mean(1) >= threshold - MARGIN if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _confirm(percent: int):
    """Rows (u, v, full sets) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (a, b))
                if len(a) and len(b):
                    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                    shared = int((a[at] == b).sum())
                    good[i] = 100 * shared >= percent * (len(a) + len(b) - shared) and shared > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))

    return run


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (u, v) whose signatures agree well enough."""
    sign = classes.select("cls", "signature")
    both = pairs.join(sign.select(F.col("cls").alias("u"), F.col("signature").alias("su")), "u").join(sign.select(F.col("cls").alias("v"), F.col("signature").alias("sv")), "v")
    return materialize(both.select("u", "v", "su", "sv").mapInArrow(_alike(percent / 100), "u bigint, v bigint"))


def _full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cls, items) for the classes of wanted, made anew from the text of each class's first document. Texts are shuffled only if there are too many ids to be sent to all tasks."""
    keys = materialize(classes.join(wanted, "cls").select("cls", "digest", "place.ident"))
    texts = docs.join(keys.select(F.col("ident").alias("_wanted")).distinct(), F.col("ident").eqNullSafe(F.col("_wanted")), "left_semi")
    made = texts.select(F.lit(True).alias("carried"), "text").mapInArrow(_sets(k), "carried boolean, digest binary, items array<bigint>")
    return materialize(made.join(keys.select("digest", "cls"), "digest").groupBy("cls").agg(F.first("items").alias("items")))


def _linked(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that pass the exact check on the full sets."""
    both = near.join(sets.select(F.col("cls").alias("u"), F.col("items").alias("iu")), "u").join(sets.select(F.col("cls").alias("v"), F.col("items").alias("iv")), "v")
    return materialize(both.select("u", "v", "iu", "iv").mapInArrow(_confirm(percent), "u bigint, v bigint"))


def _hubs(bucketed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets that two classes or more share, and each such bucket's hub: the class that shares most over all buckets.

    What a group of copies was made from shares more with each copy than copies do among themselves.
    """
    sizes = materialize(bucketed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = materialize(bucketed.join(sizes, "bucket"))
    discard(sizes)
    shares = splittable(buckets.groupBy("cls").agg(F.sum("n").alias("shares")), buckets)
    hubs = buckets.join(shares, "cls").groupBy("bucket").agg(F.max(F.struct("shares", "cls")).alias("x")).select("bucket", F.col("x.cls").alias("hub"))
    return buckets, splittable(hubs, buckets)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNTED_BITS, np.int64)
    for batch in batches:
        items = batch.column(0).flatten().to_numpy().view(np.uint64)
        total += np.bincount((items >> np.uint64(64 - COUNTED_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])


def _rarest(counts, percent: int):
    """Rows (cls, comp, items) to one row for each shingle among the rarest, of which two sets that are alike enough share one: (item, cls, comp, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column(2)[i].values.to_numpy().view(np.uint64)
                many = len(items) - -(-percent * len(items) // 100) + 1
                order = np.lexsort((items, often[(items >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)]))[:many]
                own = [pa.array(np.full(many, batch.column(j)[i].as_py())) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(items[order].view(np.int64)), *own, pa.array(np.full(many, len(items)))], ["item", "cls", "comp", "size"])

    return run


def _left_apart(buckets: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, comp) of the classes in buckets of three or more whose hub left them in different components."""
    label = splittable(classes.select("cls").join(found, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("comp")), buckets)
    member = splittable(buckets.where("n > 2").join(label, "cls").select("bucket", "cls", "comp"), buckets)
    mixed = splittable(member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket"), buckets)
    return materialize(member.join(mixed, "bucket").select("cls", "comp").distinct())


def _met(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, cls, comp, size): for each component key the classes that are its own or share one of their rarest shingles with it, where it has most rows of that shingle."""
    spark = apart.sparkSession
    counts = np.zeros(1 << COUNTED_BITS, np.int64)
    got = sets.select("items").mapInArrow(_frequencies, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    rare = apart.join(sets, "cls").select("cls", "comp", "items").mapInArrow(_rarest(spark.sparkContext.broadcast(counts), percent), "item bigint, cls bigint, comp bigint, size bigint")
    rare = materialize(rare)
    per = rare.groupBy("item", "comp").agg(F.count("*").alias("n")).groupBy("item").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("x"))
    mixed = materialize(per.where("comps > 1").select("item", F.col("x.comp").alias("key")))
    out = materialize(rare.join(mixed, "item").select("key", "cls", "comp", "size").distinct())
    discard(rare)
    return out


def _blocks(percent: int):
    """Two blocks of classes (cls, comp, signature, items; left and right by side) to confirmed links (u, v): for each left class one to each other component that it is linked with."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column = lambda name: rows.column(name).chunk(0)
        left, cls, comp = (column(n).to_numpy(zero_copy_only=False) for n in ("left", "cls", "comp"))
        signs = np.frombuffer(b"".join(column("signature").to_pylist()), np.uint16).reshape(len(cls), -1)
        ends, flat = column("items").offsets.to_numpy(), column("items").values.to_numpy().view(np.uint64)
        size = np.diff(ends)
        b = np.flatnonzero(~left)
        us, vs = [], []
        for i in np.flatnonzero(left):
            other = b[(comp[b] != comp[i]) & (100 * np.minimum(size[b], size[i]) >= percent * np.maximum(size[b], size[i]))]
            like = (signs[other] == signs[i]).mean(1)
            order = np.argsort(-like, kind="stable")[: int((like >= percent / 100 - MARGIN).sum())]
            other, own = other[order], flat[ends[i] : ends[i + 1]]
            for c in np.unique(comp[other]):
                near = other[comp[other] == c]
                for lo in range(0, len(near), AT_ONCE):
                    some = near[lo : lo + AT_ONCE]
                    items = np.concatenate([flat[ends[j] : ends[j + 1]] for j in some])
                    at = np.minimum(np.searchsorted(own, items), len(own) - 1)
                    shared = np.add.reduceat((own[at] == items).astype(np.int64), np.cumsum(size[some]) - size[some])
                    good = 100 * shared >= percent * (size[some] + size[i] - shared)
                    if good.any():
                        us.append(cls[i])
                        vs.append(cls[some[np.argmax(good)]])
                        break
        us, vs = np.array(us, np.int64), np.array(vs, np.int64)
        return pa.table({"u": np.minimum(us, vs), "v": np.maximum(us, vs)})

    return run


def _links_between(apart: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) between classes of different components: all of a component's visitors against all of its rows, in pairs of blocks."""
    met = _met(apart, sets, percent)
    guest = F.col("comp") != F.col("key")
    parts = lambda n, items: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(items / F.lit(BLOCK_ITEMS))).cast("int")
    sizes = met.groupBy("key").agg(parts(F.count_if(guest), F.sum(F.when(guest, F.col("size")))).alias("is"), parts(F.count("*"), F.sum("size")).alias("js"))
    dealt = met.join(splittable(sizes, met), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("cls", "key"), F.col(n)).cast("int")
    left = dealt.where(guest).select("key", "cls", "comp", F.lit(True).alias("left"), own("is").alias("i"), every("js").alias("j"))
    right = dealt.select("key", "cls", "comp", F.lit(False).alias("left"), every("is").alias("i"), own("js").alias("j"))
    load = sets.join(classes.select("cls", "signature"), "cls")
    return materialize(left.union(right).join(load, "cls").groupBy("key", "i", "j").applyInArrow(_blocks(percent), "u bigint, v bigint"))


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (ident, text): its rows (ident, n_shingles, digest), and for each class (digest, least: the component's first place)."""
    kind = docs.schema["ident"].dataType.simpleString()
    rows = materialize(docs.select("ident", "text").mapInArrow(_signatures(k), f"ident {kind}, n_shingles bigint, digest binary, signature binary"))
    place = F.struct(F.col("ident").isNull().alias("none"), F.col("ident").alias("ident"), F.col("digest").alias("digest"))
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(place).alias("place"), F.first("signature").alias("signature"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    bands = F.posexplode(F.array(*[F.substring("signature", 2 * ROWS * i + 1, 2 * ROWS) for i in range(BANDS)])).alias("band", "part")
    buckets, hubs = _hubs(classes.select("cls", bands).select("cls", F.xxhash64("band", "part").alias("bucket")))
    star = buckets.join(hubs, "bucket").where("cls <> hub").select(F.least("cls", "hub").alias("u"), F.greatest("cls", "hub").alias("v")).distinct()
    near = _near(star, classes, percent)
    sets = _full_sets(near.select(F.explode(F.array("u", "v")).alias("cls")).distinct(), classes, docs, k)
    found = components(_linked(near, sets, percent))
    discard(sets)
    apart = _left_apart(buckets, found, classes)
    discard(buckets)
    if apart.take(1):
        sets = _full_sets(apart.select("cls"), classes, docs, k)
        more = _links_between(apart, sets, classes, percent)
        if more.take(1):
            found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    rooted = splittable(classes.join(found, F.col("cls") == F.col("node"), "left").select("digest", "place", F.coalesce("root", "cls").alias("root")), classes)
    least = splittable(rooted.groupBy("root").agg(F.min("place").alias("least")), classes)
    return rows.select("ident", "n_shingles", "digest"), rooted.join(least, "root").select("digest", "least")


def _plain(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("ident"), text_of(text_column).alias("text"))


@operator
def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: its id, n_shingles, component_id, kept.

    Links join documents with 100 * intersection >= percent * union of their sets of distinct shingles of k words
    (lower case for A-Z), whole texts of any length. component_id is the least id reachable (ids of any type that has an order), null ids apart; kept: it is
    the document's own. Without words or text a document links with nothing, and is its own component. A null id is never a component's
    id: such a document has its group's, or null and kept if there is none. Rows that repeat an id and text share one
    result each. Empty tables give empty results; other columns are not looked at.
    """
    rows, labels = _grouped(_plain(docs, id_column, text_column), k, percent)
    out = rows.join(labels, "digest", "left").select("ident", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least.ident")).otherwise(F.col("ident")).alias("component_id"))
    return out.select(F.col("ident").alias(id_column), "n_shingles", "component_id", F.col("ident").eqNullSafe(F.col("component_id")).alias("kept"))


@operator
def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, columns as they are, with one row of each group of near copies: the first by id, null ids last.

    Documents without words stay, each row of them. Of rows that repeat an id and a set of shingles, one stays. Else as near_duplicates().
    """
    rows, labels = _grouped(_plain(docs, id_column, text_column), k, percent)
    first = F.col("ident").eqNullSafe(F.col("least.ident")) & (F.col("digest") == F.col("least.digest"))
    judged = materialize(rows.join(labels, "digest", "left").select("ident", "digest", "n_shingles", ((F.col("n_shingles") == 0) | first).alias("keep")))

    def pick(odd: DataFrame) -> DataFrame:
        kind = odd.schema["_row"].dataType
        shape = T.StructType([T.StructField("carried", T.StructType([T.StructField("_row", kind), T.StructField("_ident", odd.schema["_ident"].dataType)])), T.StructField("digest", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))])
        made = odd.select(F.struct("_row", "_ident").alias("carried"), text_of(f"_row.{text_column}").alias("text")).mapInArrow(_sets(k), shape)
        kept = judged.where("keep").select(F.col("ident").alias("i"), F.col("digest").alias("d")).distinct()
        found = made.join(kept, F.col("carried._ident").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")))
        empty = found.where(F.size("items") == 0).select("carried._row")
        return empty.union(found.where(F.size("items") > 0).groupBy("i", "d").agg(F.first("carried._row").alias("_row")).select("_row"))

    return chosen_rows(docs, id_column, judged.select("ident", "keep"), pick)
