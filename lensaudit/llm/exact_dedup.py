"""Exact de-duplication over a sharded cuckoo-filter index.

Digests of normalised texts are spread over shards by the digest itself, so no shard holds a key's rows but
one row for each input partition: every task first collapses its own copies in an index of its own. A shard's
index answers most look-ups from a table of 16-bit fingerprints; a hit is verified against the content kept
with the bucket (the whole SHA-256 digest), so a false positive of the filter never merges two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, chosen_rows, materialize, operator, text_of

#: Keys that an index holds, about: some 100 MB of Python objects. A task's own index is handed on at so many, a shard is cut to so many.
SHARD_KEYS = 250_000
_SLOTS = 4
_KICKS = 64


class CuckooIndex:
    """A cuckoo filter with the keys' contents beside the fingerprints.

    insert() and delete() keep the live count of each key; a key whose count falls to 0 leaves its slot, and a
    later insert takes it anew. When kicks find no free slot, the table doubles and is refilled from the stored keys.
    """

    def __init__(self, buckets: int = 64):
        self._reset(1 << max(1, (buckets - 1).bit_length()))

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.cells: list[list[list]] = [[] for _ in range(buckets)]
        self.size = 0

    def _place(self, key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[2:10], "little") & self.mask, int.from_bytes(key[:2], "little") | 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) >> 3 & self.mask)

    def find(self, key: bytes) -> list | None:
        """The cell [key, live count, least id] of a live key."""
        at, mark = self._place(key)
        for bucket in (at, self._other(at, mark)):
            if mark in self.prints[bucket]:
                for cell in self.cells[bucket]:
                    if cell[0] == key:
                        return cell
        return None

    def insert(self, key: bytes, ident: int | None, copies: int = 1) -> bool:
        """True if the key wasn't live before."""
        cell = self.find(key)
        if cell is not None:
            cell[1] += copies
            if ident is not None and (cell[2] is None or ident < cell[2]):
                cell[2] = ident
            return False
        self._put([key, copies, ident])
        return True

    def _put(self, cell: list) -> None:
        at, mark = self._place(cell[0])
        for bucket in (at, self._other(at, mark)):
            if len(self.prints[bucket]) < _SLOTS:
                self.prints[bucket].append(mark)
                self.cells[bucket].append(cell)
                self.size += 1
                return
        bucket = at
        for kick in range(_KICKS):
            slot = kick % _SLOTS
            mark, self.prints[bucket][slot] = self.prints[bucket][slot], mark
            cell, self.cells[bucket][slot] = self.cells[bucket][slot], cell
            bucket = self._other(bucket, mark)
            if len(self.prints[bucket]) < _SLOTS:
                self.prints[bucket].append(mark)
                self.cells[bucket].append(cell)
                self.size += 1
                return
        self._grow(cell)

    def _grow(self, extra: list) -> None:
        held = [*self, extra]
        self._reset(2 * (self.mask + 1))
        for cell in held:
            self._put(cell)

    def delete(self, key: bytes, copies: int = 1) -> bool:
        """True if the key was live; other keys with its fingerprint stay."""
        at, mark = self._place(key)
        for bucket in (at, self._other(at, mark)):
            for slot, cell in enumerate(self.cells[bucket]):
                if cell[0] == key:
                    cell[1] -= copies
                    if cell[1] <= 0:
                        del self.cells[bucket][slot], self.prints[bucket][slot]
                        self.size -= 1
                    return True
        return False

    def __iter__(self) -> Iterator[list]:
        for bucket in self.cells:
            yield from bucket

    def __len__(self) -> int:
        return self.size


def _rows(index: CuckooIndex, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows = list(index)
    for lo in range(0, len(rows), 20_000):
        part = rows[lo : lo + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in zip((0, 2, 1), kinds, strict=True)], names)


def _index(whole: bool):
    """Rows (digest, ident, copies) to one row a live digest; negative copies delete.

    Deletions wait for the insertions of their batch, and those of a key that isn't live yet for the end. whole: the task has all rows
    of its digests; if not, there are only insertions, and the index is handed on whenever it has SHARD_KEYS keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, owed = CuckooIndex(), {}
        names, kinds = ["digest", "ident", "copies"], None
        for batch in batches:
            kinds = [c.type for c in batch.columns]
            for digest, ident, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if copies > 0:
                    index.insert(digest, ident, copies)
                elif copies < 0:
                    owed[digest] = owed.get(digest, 0) - copies
            for digest in [d for d in owed if index.find(d) is not None and index.find(d)[1] >= owed[d]]:
                index.delete(digest, owed.pop(digest))
            if not whole and len(index) >= SHARD_KEYS:
                yield from _rows(index, names, kinds)
                index = CuckooIndex()
        for digest, copies in owed.items():
            index.delete(digest, copies)
        if kinds:
            yield from _rows(index, names, kinds)

    return run


def digest(text_column: str = "text"):
    """SHA-256 (lowercase hex) of the text with each run of white space replaced by one space; null is empty."""
    return F.sha2(F.regexp_replace(text_of(text_column), f"{SPACE_CLASS}+", " "), 256)


@operator
def live_index(keyed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(digest binary, ident: least id, copies) for each live digest of keyed (digest, ident); deleted: digests to take out, one row a copy.

    Ids are of any type that has an order; null ids are above all others. Repeated rows count as copies; deletions of digests that aren't live do nothing.
    Empty tables give an empty index. Other columns are not looked at.
    """
    kind = keyed.schema["ident"].dataType.simpleString()
    entry = f"digest binary, ident {kind}, copies bigint"
    rows = keyed.select("digest", "ident", F.lit(1).cast("bigint").alias("copies"))
    local = rows.mapInArrow(_index(False), entry)
    if deleted is not None:
        local = local.unionByName(deleted.groupBy("digest").agg((-F.count("*")).alias("copies")).select("digest", F.lit(None).cast(kind).alias("ident"), "copies"))
    local = materialize(local)
    shards = max(int(local.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-local.count() // SHARD_KEYS))
    return local.repartition(shards, "digest").mapInArrow(_index(True), entry)


def _digested(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return materialize(docs.select(F.col(id_column).alias("ident"), F.unhex(digest(text_column)).alias("digest")))


@operator
def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: its id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; texts of any length are digested whole. Of equal texts the row with the least id stays (ids of any type that
    has an order); null ids are above all others, and a group of null ids only has a null keep_id. Rows that repeat an id with its text are all
    marked kept if that id is the least. An empty table gives an empty result; other columns are not looked at.
    """
    rows = _digested(docs, id_column, text_column)
    found = live_index(rows).select("digest", F.col("ident").alias("keep_id"), F.col("copies").alias("group_size"))
    out = rows.join(found, "digest").select("ident", "keep_id", "group_size", F.col("ident").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return out.withColumnRenamed("ident", id_column)


@operator
def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, with one row of each group of equal texts: that of the least id, any one of rows that repeat it.

    Nulls, ids, long texts and empty tables as in exact_dedup(); extra columns of any name go along.
    """
    rows = _digested(docs, id_column, text_column)
    index = materialize(live_index(rows).select("digest", F.col("ident").alias("keep_id")))
    verdicts = rows.join(index, "digest").select("ident", F.col("ident").eqNullSafe(F.col("keep_id")).alias("keep"))

    def pick(odd: DataFrame) -> DataFrame:
        own = odd.select("_row", "_ident", F.unhex(digest(f"_row.{text_column}")).alias("digest")).join(index, "digest")
        return own.where(F.col("_ident").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.first("_row").alias("_row"))

    return chosen_rows(docs, id_column, verdicts, pick)
