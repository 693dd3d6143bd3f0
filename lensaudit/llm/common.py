"""Shared pieces: the folder all executors see, native text expressions, and numpy kernels over Arrow text."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_code

#: Fixed by the contracts: what separates words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Sets the second 64 bits of a key apart from the first.
_SECOND = 0x5DEECE66D


# --- session -------------------------------------------------------------------------------------

#: Folders of local sessions that have no spark.checkpoint.dir, by application.
_FOLDERS: dict[str, str] = {}


def _path(spark: SparkSession, at: str):
    """A path and its file system, as Hadoop has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which is only read; a local session without one gets a temporary folder, deleted at its end."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _FOLDERS:
        at = _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="lensaudit-")
        path, system = _path(spark, f"file://{at}")
        system.deleteOnExit(path)
    return f"file://{_FOLDERS[context.applicationId]}"


#: Bytes of a batch that goes to a Python worker, where the session leaves Spark's default of 64 MB: both sides hold several, in buffers that double as they fill.
_BATCHES, _SPARKS_OWN, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "1m"
#: Rows that a Parquet reader holds decoded, where the session leaves Spark's default of 4,096: texts of all of them lie in one array.
_READ, _SPARKS_READ, READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize", "4096", "512"
#: With this on, Spark deletes a plan's shuffle files when its action ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """For jobs: bound the session's Arrow batches by bytes, and the rows that readers hold. Thousands of long texts are too much for a small executor; operators leave the settings alone."""
    for name, default, bound in ((_BATCHES, _SPARKS_OWN, BATCH_BYTES), (_READ, _SPARKS_READ, READ_ROWS)):
        if spark.conf.get(name) == default:
            spark.conf.set(name, bound)


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Bounded batches and early deletion of shuffle files for the actions of an operator; afterwards all is as it was."""
    before = {name: spark.conf.get(name, None) for name in (_BATCHES, _READ, _CLEANUP)}
    bound_batches(spark)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class _Runs(threading.local):
    """Tables written by the operators that are running in this thread, the innermost last."""

    def __init__(self):
        self.stack: list[list[str]] = []


_RUNS = _Runs()


def _read_by(df: DataFrame) -> set[str]:
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(j).toUri().getPath() for j in range(roots.size())}
    return found


def operator(f: Callable) -> Callable:
    """For functions of a table (their first argument): code is shipped, settings hold while f runs, and all tables that f wrote are deleted
    when it returns, but for those that its result reads. These go when the driver ends."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs):
        spark = df.sparkSession
        ship_code(spark)
        own: list[str] = []
        used: set[str] = set()
        _RUNS.stack.append(own)
        try:
            with _settings(spark):
                out = f(df, *args, **kwargs)
                used = _read_by(out) if isinstance(out, DataFrame) else used
        finally:
            _RUNS.stack.pop()
            for at in own:
                path, system = _path(spark, at)
                if path.toUri().getPath() not in used:
                    system.delete(path, True)
                elif _RUNS.stack:
                    _RUNS.stack[-1].append(at)
        return out

    return run


def materialize(df: DataFrame, files: int | None = None, group_bytes: int | None = None) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again.

    A lost executor loses nothing, as the folder outlives executors. The table goes with its operator(), or when the driver ends.
    files: rebalance into about so many files (default: as the plan has them). group_bytes: of a row group; its reader holds up to 4,096 rows of one, so tables
    of large rows need small ones.
    """
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    (df.repartition(files) if files else df).write.options(**({"parquet.block.size": group_bytes} if group_bytes else {})).parquet(out)
    path, system = _path(spark, out)
    system.deleteOnExit(path)
    if _RUNS.stack:
        _RUNS.stack[-1].append(out)
    table = spark.read.schema(df.schema).parquet(out)
    table._llm_path = out
    return table


#: Bytes of a written table up to which any of its partitions fits a task, however skewed its keys are.
SMALL = 32 << 20


def is_small(table: DataFrame) -> bool:
    """By the sizes of a written table's files; no job."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def splittable(df: DataFrame, source: DataFrame) -> DataFrame:
    """An aggregate that goes into a join with source, as a written table where source is large: then a hot key's partition can be split."""
    return df if is_small(source) else materialize(df)


def discard(table: DataFrame) -> None:
    """Delete a table of materialize() that no later plan reads."""
    at = getattr(table, "_llm_path", None)
    if at:
        path, system = _path(table.sparkSession, at)
        system.delete(path, True)
        system.cancelDeleteOnExit(path)
        for own in _RUNS.stack:
            if at in own:
                own.remove(at)


def chosen_rows(docs: DataFrame, id_column: str, verdicts: DataFrame, pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that verdicts (ident, keep; a row for each of docs) keep, columns as they are.

    Where an id stands for one row, the id decides. Rows that repeat an id, or have none, go to pick as (_row, _ident), which returns (_row).
    """
    per = verdicts.groupBy("ident").agg(F.count("*").alias("n"), F.bool_or("keep").alias("keep"))
    away = materialize(per.where("n > 1 OR NOT keep OR ident IS NULL").select(F.col("ident").alias("_away"), "n"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_column).alias("_ident"))
    matches = F.col("_ident").eqNullSafe(F.col("_away"))
    sure = rows.join(away, matches, "left_anti").select("_row")
    odd = away.where("n > 1 OR _away IS NULL")
    if odd.take(1):
        sure = sure.union(pick(rows.join(odd, matches, "left_semi")).select("_row"))
    return sure.select("_row.*")


# --- native expressions --------------------------------------------------------------------------


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bucket_of(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def row_key(id_column: str, text_column: str) -> Column:
    """128 bits that rows share only when both id and text agree."""
    both = (F.col(id_column).isNull(), F.col(id_column), F.col(text_column).isNull(), F.col(text_column))
    return F.struct(F.xxhash64(*both).alias("a"), F.xxhash64(F.lit(_SECOND), *both).alias("b"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, learn: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(ident, text, label) for about `bound` labelled documents, drawn by a hash of the id; at most twice so many ids are broadcast.

    learn: which labels may be used, an expression over the id. Null labels and ids are left out; of an id's labels the greatest counts.
    """
    usable = labels.where(learn & F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_of"), F.col(label).cast("int").alias("label"))
    n = usable.count()
    drawn = usable.where(F.pmod(F.xxhash64("_of"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / max(n, 1)))).groupBy("_of").agg(F.max("label").alias("label")).limit(2 * bound)
    return docs.select(F.col(id_column).alias("ident"), text_of(text_column).alias("text")).join(F.broadcast(drawn), F.col("ident") == F.col("_of")).select("ident", "text", "label")


# --- numpy over Arrow text -----------------------------------------------------------------------

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[ASCII_LOWER]
_BASE = tuple(int(x) | 1 for x in _RNG.integers(2**62, 2**63, 2))
_M64 = (1 << 64) - 1
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, or the same of the base's inverse."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = _BASE[which]
        base = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _POWERS[which, inverse] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, and where each row begins in them, without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slabs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes, so that working arrays stay small: first row, end, bytes, offsets from 0."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end bytes of all words, and the number of the first word of each row (rows + 1); between: what bytes part words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~between[data]
    new = np.empty(n, bool)
    new[0] = True
    np.logical_not(word[:-1], out=new[1:])
    new[offs[:-1][offs[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = new[1:] | ~word[1:]
    begin = np.flatnonzero(word & new)
    end = np.flatnonzero(word & last) + 1
    return begin, end, np.searchsorted(begin, offs)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of 64 bits for each span of bytes; lower: A-Z count as a-z."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(0, len(data)), out=sums[1:])
    return mix((sums[end] - sums[begin]) * powers(0, len(data) + 1, True)[begin] + (end - begin).astype(np.uint64))


def sequence_sums(items: np.ndarray) -> np.ndarray:
    sums = np.empty(len(items) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(items * powers(1, len(items)), out=sums[1:])
    return sums


def sequence_hashes(sums: np.ndarray, begin: np.ndarray, length) -> np.ndarray:
    """A hash for each run of items, from sequence_sums(); length: one for all, or one each."""
    return mix((sums[begin + length] - sums[begin]) * powers(1, len(sums), True)[begin] + np.uint64(1) * np.asarray(length).astype(np.uint64))


def aranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] of them), begin[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(begin - (ends - count), count)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
