"""Removal of byte strings that repeat across documents, by merging Burrows-Wheeler transforms of shards.

A window of 50 bytes is told by its anchor, the 20-byte gram in it whose hash is least. Windows of a document in a row that share an occurrence of their anchor are
a segment, some 65 bytes that start about every 15 bytes. Equal windows have equal anchors at equal places, so
anchors that occur in one document alone can't hold a repeated window, and their segments go no further: tasks exchange 48 bits an anchor to learn which do.

The other segments meet by their anchors in buckets, aligned at the anchor. A shard, some thousands of segments, has a transform: for each column, from the right, the bytes
that precede its suffixes in their sorted order. The transforms of a bucket's shards are merged by refining their interleave column by column: the interleave
says in which order the shards give their next symbol, and a stable counting of these symbols gives the interleave one column further left; no suffix is compared or sorted
again. Lengths of common prefixes follow from the least length between two suffixes before the step. Intervals of at least 50 common bytes are repeated windows; those rows go whose document is larger than the
least of the interval.

Copies of one text, and equal segments of one block of texts, are one from the start. An anchor that occurs more often than a bucket may hold has its windows dealt out one by one, by
their own hashes, where equal ones are one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegralType, LongType, StructType

from .common import _BYTE, aranges, discard, is_small, materialize, mix, operator, powers, slabs, text_of

#: Places an anchor may have in a window, less one, at most; so anchors of 50-byte windows have 20 bytes.
SPAN = 30
#: Bytes of texts in a block (a longer text is a block of its own), and window starts that are looked at together.
BLOCK_BYTES, PIECE = 1 << 20, 1 << 16
#: Anchors and segments that a bucket should hold; occurrences from which an anchor is dealt out by windows; segments of a shard.
BUCKET_KEYS, BUCKET_ROWS, HOT, SHARD = 1 << 20, 1 << 17, 1 << 19, 1 << 14
#: What a null id counts as: larger than all others.
LAST = (1 << 63) - 1
_U = np.uint64
_SHARED, _HOT = 1, 2


# --- blocks of texts -----------------------------------------------------------------------------


def _blocks(window: int, schema: pa.Schema):
    """Rows (ident, ord, text, copy) to blocks; of copies that all goes of (at least a window long), the lengths alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            gone = batch.column(3).to_numpy(zero_copy_only=False) & (lengths >= window)
            stay, away = batch.filter(pa.array(~gone)), batch.filter(pa.array(gone))
            cuts = [(lo, hi, _compressed(data.tobytes()), offs[1:]) for lo, hi, data, offs in slabs(stay.column(2), BLOCK_BYTES)] or [(0, 0, _compressed(b""), np.zeros(0, np.int64))]
            for i, (lo, hi, data, ends) in enumerate(cuts):
                out = away if i == 0 else away.slice(0, 0)
                lists = [stay.column(0).slice(lo, hi - lo), stay.column(1).slice(lo, hi - lo), pa.array(ends), out.column(0), pa.array(lengths[gone][: len(out)].astype(np.int64))]
                columns = [pa.array([number]), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                number += 1

    return run


def _column(table, name: str) -> np.ndarray:
    """The list of a table's one row."""
    return table.column(name).chunk(0).flatten().to_numpy(zero_copy_only=False)


def _compressed(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def _bytes(table, ends: np.ndarray) -> np.ndarray:
    """A block's texts, which are stored and shuffled compressed."""
    return np.frombuffer(pa.Codec("zstd").decompress(table.column("text")[0].as_buffer(), int(ends[-1]) if len(ends) else 0), np.uint8)


def _segments(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a block's texts as segments: first window's start, the anchor's place in it, windows, 48 bits of the anchor's hash."""
    span = min(SPAN, window // 2)
    k, begins = window - span, np.concatenate(([0], ends[:-1])).astype(np.int64)
    out: list[tuple] = []
    for lo in range(0, max(len(data) - window + 1, 0), PIECE):
        part = data[lo : lo + PIECE + window - 1]
        sums = np.empty(len(part) + 1, _U)
        sums[0] = 0
        np.cumsum(_BYTE[part] * powers(0, len(part)), out=sums[1:])
        grams = mix((sums[k:] - sums[:-k]) * powers(0, len(part) + 1, True)[: len(part) - k + 1])
        least = (grams & ~_U((1 << 19) - 1)) | np.arange(len(grams), dtype=_U)
        have = 1
        while have < span + 1:
            step = min(have, span + 1 - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        docs = slice(np.searchsorted(ends, lo, "right"), np.searchsorted(begins, lo + PIECE))
        first = np.maximum(begins[docs], lo)
        start = aranges(first - lo, np.maximum(np.minimum(ends[docs] - window + 1, lo + PIECE) - first, 0))
        if len(start):
            anchor = (least[start] & _U((1 << 19) - 1)).astype(np.int64)
            head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            out.append((lo + start[head], (anchor - start)[head].astype(np.uint8), np.diff(np.append(head, len(start))).astype(np.uint8), mix(grams[anchor[head]] ^ _U(1)) >> _U(16)))  # mixed again: least hashes are small ones
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- which anchors several documents have ---------------------------------------------------------


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 48-bit keys, in the keys' order."""
    return ((keys >> _U(16)) * _U(buckets) >> _U(32)).astype(np.int32)


def _cuts(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values: value, begin, end."""
    heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))[: len(of)]
    yield from zip(of[heads].tolist(), heads.tolist(), np.append(heads, len(of))[1:].tolist(), strict=True)


def _keys(window: int, buckets: int):
    """Blocks to (block, bucket, entries): a block's different anchors in order, 48 bits each, then a bit for several documents and 15 for occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.table(batch.slice(i, 1))
                ends = _column(row, "ends")
                start, _, _, key = _segments(_bytes(row, ends), ends, window)
                if not len(start):
                    continue
                order = np.argsort(key, kind="stable")
                key, owner = key[order], _column(row, "ords")[np.searchsorted(ends, start, "right")][order]
                heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                several = np.minimum.reduceat(owner, heads) < np.maximum.reduceat(owner, heads)
                many = np.minimum(np.diff(np.append(heads, len(key))), (1 << 15) - 1)
                key = key[heads]
                entries = (key << _U(16)) | (several.astype(_U) << _U(15)) | many.astype(_U)
                cuts = list(_cuts(_bucket(key, buckets)))
                block = row.column("block")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cuts), pa.int64()), pa.array([c[0] for c in cuts], pa.int32()), pa.array([entries[a:b].tobytes() for _, a, b in cuts], pa.binary())], ["block", "bucket", "entries"])

    return run


def _joined(column, dtype) -> tuple[np.ndarray, list[int]]:
    """Values of all rows of a binary column one after the other, and where each row's begin."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), [0, *np.cumsum([len(p) for p in parts]).tolist()]


def _flags(hot: int):
    """A bucket's entries to a byte each (0: in one document, 1: in several, 2: in several, and too often for a bucket), and the segments that go on."""

    def run(group: pa.Table) -> pa.Table:
        entries, at = _joined(group.column("entries"), _U)
        order = np.argsort(entries, kind="stable")
        key, low = entries[order] >> _U(16), (entries[order] & _U(0xFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(heads, len(key)))
        several = (size > 1) | (np.maximum.reduceat(low >> 15, heads) > 0)
        verdict = several.astype(np.uint8) * np.where(np.add.reduceat(low & 0x7FFF, heads) > hot, _HOT, _SHARED).astype(np.uint8)
        flags = np.empty(len(key), np.uint8)
        flags[order] = np.repeat(verdict, size)
        onward = (flags > 0) * (entries & _U(0x7FFF)).astype(np.int64)
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "flags": pa.array([flags[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()), "rows": pa.array([int(onward[a:b].sum()) for a, b in zip(at, at[1:], strict=False)], pa.int64())})

    return run


# --- segments, shards, transforms ----------------------------------------------------------------


def _rows(data: np.ndarray, start: np.ndarray, left: np.ndarray, run: np.ndarray, window: int) -> np.ndarray:
    """Segments aligned at their anchors, a row each, filled up with zeros on both sides; an even number of columns right of the anchor's begin."""
    span, width = min(SPAN, window // 2), window + window % 2
    to = np.arange(span + width) - span + left[:, None].astype(np.int64)
    out = data[np.minimum(np.maximum(start[:, None] + to, 0), max(len(data) - 1, 0))]
    out[(to < 0) | (to >= run[:, None].astype(np.int64) + window - 1)] = 0
    return out


def _classes(data: np.ndarray, start: np.ndarray, left: np.ndarray, run: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each segment and a member of each class: equal segments at equal places of their anchors are one, byte for byte."""
    prints = np.empty(len(start), _U)
    for lo in range(0, len(start), 8192):
        own = slice(lo, lo + 8192)
        rows = _rows(data, start[own], left[own], run[own], window)
        words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
        words[:, : rows.shape[1]] = rows
        words = words.view(_U)
        total = left[own].astype(_U) * _U(256) + run[own].astype(_U)
        for j in range(words.shape[1]):
            total = mix(total * _U(0x9E3779B97F4A7C15) + words[:, j] + _U(j + 1))
        prints[own] = total
    _, member, of = np.unique(prints, return_index=True, return_inverse=True)
    odd = (left != left[member][of]) | (run != run[member][of])
    for lo in range(0, len(start), 8192):
        own = slice(lo, lo + 8192)
        first = member[of[own]]
        odd[own] |= (_rows(data, start[own], left[own], run[own], window) != _rows(data, start[first], left[first], run[first], window)).any(1)
    for i in np.flatnonzero(odd):  # another segment with the same 64 bits
        of[i] = len(member)
        member = np.append(member, i)
    return of, member


def _shares(window: int, buckets: int):
    """A block and its anchors' flags to (block, bucket, docs, left, run, body): a row for each bucket with the different segments that go there, and in bucket -1
    what the block needs to apply their masks: all segments that went on, with their classes in the order of the other rows."""

    def run_(texts: pa.Table, flags: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("block", "bucket", "docs", "left", "run", "body")}
        shape = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in ("docs", "left", "run", "body")]])
        texts, flags = texts.combine_chunks(), flags.combine_chunks()
        if texts.num_rows and flags.num_rows:
            ends = _column(texts, "ends")
            data = _bytes(texts, ends)
            start, left, run, key = _segments(data, ends, window)
            verdict = _joined(flags.take(pa.compute.sort_indices(flags, [("bucket", "ascending")])).column("flags"), np.uint8)[0][np.unique(key, return_inverse=True)[1]]
            own, hot = verdict == _SHARED, verdict == _HOT
            each = np.repeat(np.flatnonzero(hot), run[hot])  # windows of hot anchors, one by one, without an anchor's place
            single = aranges(start[hot], run[hot].astype(np.int64))
            start, left, run, key = np.concatenate((start[own], single)), np.append(left[own], np.zeros(len(each), np.uint8)), np.append(run[own], np.ones(len(each), np.uint8)), np.append(key[own], np.zeros(len(each), _U))
            if len(start):
                of, member = _classes(data, start, left, run, window)
                rows = _rows(data, start[member], left[member], run[member], window)
                lone = member >= len(start) - len(single)
                to = key[member]
                to[lone] = _window_keys(rows[lone])
                to = _bucket(to, buckets)
                order = np.argsort(to, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                owner = _column(texts, "ords")[np.searchsorted(ends, start, "right")]
                docs = _least(owner, of, len(member))
                block = texts.column("block")[0].as_py()
                for bucket, a, b in [(-1, 0, 0), *_cuts(to[order])]:
                    at = order[a:b]
                    parts = (start, place[of], left, run) if bucket < 0 else (docs[at], rows[at], left[member[at]], run[member[at]])
                    packed = (parts[0].astype(np.int64), parts[2], parts[3], parts[1])
                    for name, value in zip(out, (block, bucket, *[np.ascontiguousarray(p).tobytes() for p in packed]), strict=True):
                        out[name].append(value)
        return pa.table(out, schema=shape)

    return run_


def _window_keys(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows), _U)
    for j in range(rows.shape[1]):
        total = total * _U(0x9E3779B97F4A7C15) + _BYTE[rows[:, j]]
    return mix(total) >> _U(16)


def _least(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST)
    np.minimum.at(out, of, values)
    return out


def symbols(rows: np.ndarray, step: int, span: int) -> np.ndarray:
    """What the columns of a step hold, from the right: two bytes each right of the anchors' begin, then one."""
    double = (rows.shape[1] - span) // 2
    if step < double:
        at = rows.shape[1] - 2 * step - 2
        return rows[:, at].astype(np.uint16) << 8 | rows[:, at + 1]
    return rows[:, span - 1 - (step - double)].astype(np.uint16)


def transform(rows: np.ndarray, span: int) -> np.ndarray:
    """A shard's transform: for each step, the symbols that precede its suffixes, in the order of these."""
    steps = (rows.shape[1] - span) // 2 + span
    out, order = np.empty((steps, len(rows)), np.uint16), np.arange(len(rows))
    for step in range(steps):
        out[step] = symbols(rows, step, span)[order]
        order = order[np.argsort(out[step], kind="stable")]
    return out


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo : hi + 1] for each pair, by tables of runs of 1, 2, 4, ... values."""
    tables, most = [values], int((hi - lo).max(initial=0)) + 1
    while 2 << (len(tables) - 1) <= most:
        step = 1 << (len(tables) - 1)
        longer = tables[-1].copy()
        np.minimum(tables[-1][:-step], tables[-1][step:], out=longer[:-step])
        tables.append(longer)
    level = np.frexp((hi - lo + 1).astype(np.float32))[1] - 1
    flat, n = np.concatenate(tables), len(values)
    return np.minimum(flat[level * n + lo], flat[level * n + hi + 1 - (1 << level)])


def merged(shards: list[np.ndarray], window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merge shards' transforms: for each place j of a window's start before the anchor's, the rows (numbered through the shards) in the order of their suffixes from there, and
    how many bytes each shares with the one before."""
    span = min(SPAN, window // 2)
    sizes = [s.shape[1] for s in shards]
    columns = np.concatenate(shards, axis=1)
    n = columns.shape[1]
    shard = np.repeat(np.arange(len(shards)), sizes).astype(np.uint16 if len(shards) <= 1 << 16 else np.int64)
    row, at = np.arange(n), np.arange(n)  # the row at each place of the interleave, and which symbol of its shard comes there
    common = np.zeros(n, np.uint8 if window + span < 250 else np.uint16)
    double = len(columns) - span
    for step, column in enumerate(columns):
        symbol = column[at]
        order = np.argsort(symbol, kind="stable")
        a, b = order[:-1], order[1:]
        near, far = symbol[a], symbol[b]
        same = near == far
        wide = 2 if step < double else 1
        longer = np.zeros(n, common.dtype)
        if wide == 2:
            longer[1:] = near >> 8 == far >> 8
        longer[1:][same] = wide + _range_least(common, a[same] + 1, b[same])
        common, row = longer, row[order]
        if len(shards) > 1:
            at[np.argsort(shard[row], kind="stable")] = np.arange(n)
        if step >= double - 1:
            yield step - double + 1, row, common


def _repeats(window: int):
    """A bucket's segments to masks: for each segment a bit for each window that also starts in a smaller document, by the anchor's place in it."""
    span = min(SPAN, window // 2)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        docs, at = _joined(group.column("docs"), np.int64)
        left, many = (_joined(group.column(n), np.uint8)[0].astype(np.int16) for n in ("left", "run"))
        rows = _joined(group.column("body"), np.uint8)[0].reshape(len(docs), -1)
        masks = np.zeros(len(docs), np.uint32)
        for j, row, common in merged([transform(rows[lo : lo + SHARD], span) for lo in range(0, len(rows), SHARD)], window):
            again = common >= window
            if not again.any():
                continue
            some = again.copy()
            some[:-1] |= again[1:]
            own = row[some]
            interval = np.cumsum(~again[some]) - 1
            valid = (left[own] >= j) & (left[own] - many[own] < j)
            least = np.full(int(interval[-1]) + 1, LAST)
            np.minimum.at(least, interval[valid], docs[own[valid]])
            gone = own[valid & (docs[own] > least[interval])]
            masks[gone] |= np.uint32(1 << j)
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "body": pa.array([masks[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})

    return run


# --- results -------------------------------------------------------------------------------------


def _removed(data: np.ndarray, ends: np.ndarray, ords: np.ndarray, local, masks: np.ndarray, window: int) -> np.ndarray:
    """Which bytes of a block go. local: starts, classes, left and run of its shared segments; masks: of the classes."""
    start, of, left, run = local
    owner = ords[np.searchsorted(ends, start, "right")]
    later = owner > _least(owner, of, len(masks))[of]  # the least document of an equal segment has all its windows too
    every = aranges(start, run.astype(np.int64))
    each = np.repeat(np.arange(len(start)), run)
    place = (left[each] - (every - start[each])).astype(np.uint32)
    gone = every[later[each] | ((masks[of[each]] >> place) & np.uint32(1) > 0)]
    edges = np.bincount(gone, minlength=len(data) + 1)[: len(data) + 1] - np.bincount(gone + window, minlength=len(data) + 1)[: len(data) + 1]
    return np.cumsum(edges[: len(data)]) > 0


def _results(window: int, schema: pa.Schema):
    def run_(texts: pa.Table, rest: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        texts, rest = texts.combine_chunks(), rest.combine_chunks()
        ends, ords = _column(texts, "ends"), _column(texts, "ords")
        data = _bytes(texts, ends)
        gone = np.zeros(len(data), bool)
        if rest.num_rows:
            rest = rest.take(pa.compute.sort_indices(rest, [("bucket", "ascending"), ("kind", "ascending")]))
            kinds = rest.column("kind").to_numpy()
            local = rest.filter(pa.array((kinds == 0)))
            masks = _joined(rest.filter(pa.array(kinds == 1)).column("body"), np.uint32)[0]
            part = lambda n, t: np.frombuffer(local.column(n)[0].as_buffer(), t)
            gone = _removed(data, ends, ords, (part("docs", np.int64), part("body", np.int32), part("left", np.uint8), part("run", np.uint8)), masks, window)
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        head[begins[begins < len(data)]] |= gone[begins[begins < len(data)]]
        tail = gone.copy()
        tail[:-1] &= ~gone[1:]
        tail[ends[ends > 0] - 1] |= gone[ends[ends > 0] - 1]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
        so_far = np.concatenate(([0], np.cumsum(gone)))
        per = np.searchsorted(heads, ends) if len(ends) else np.zeros(0, np.int64)
        of = np.searchsorted(ends, heads, "right")
        spans = pa.StructArray.from_arrays([pa.array(heads - begins[of]), pa.array(tails - begins[of])], ["begin", "end"])
        kept = data[~gone].tobytes()
        left = ends - so_far[ends]
        away = texts.column("gone_idents").chunk(0).flatten(), _column(texts, "gone_bytes").astype(np.int64)
        whole = pa.StructArray.from_arrays([pa.array(np.zeros(len(away[1]), np.int64)), pa.array(away[1])], ["begin", "end"])
        parts = []
        if len(ends):
            parts.append([texts.column("idents").chunk(0).flatten(), pa.array(ends - begins), pa.array(so_far[ends] - so_far[begins]), pa.ListArray.from_arrays(pa.array(np.append(0, per).astype(np.int32)), spans), pa.array([kept[a:b] for a, b in zip([0, *left[:-1].tolist()], left.tolist(), strict=True)], pa.binary())])
        if len(away[1]):
            parts.append([away[0], pa.array(away[1]), pa.array(away[1]), pa.ListArray.from_arrays(pa.array(np.arange(len(away[1]) + 1, dtype=np.int32)), whole), pa.array([b""] * len(away[1]), pa.binary())])
        return pa.concat_tables([pa.table([c.cast(f.type) for c, f in zip(p, schema, strict=True)], schema=schema) for p in parts]) if parts else schema.empty_table()

    return run_


def _order(docs: DataFrame, kind: DataType) -> DataFrame:
    """docs (ident, text) with ord, a whole number in the order of ids, null last."""
    if isinstance(kind, IntegralType):
        return docs.withColumn("ord", F.coalesce(F.col("ident").cast("bigint"), F.lit(LAST)))
    sorted_ = materialize(docs.select("ident").where("ident IS NOT NULL").distinct().orderBy("ident").withColumn("at", F.monotonically_increasing_id()))
    parts = sorted_.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition of the sort
    before = dict(zip([p.part for p in parts], np.cumsum([0] + [p.n for p in parts]).tolist(), strict=False))
    offsets = docs.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part bigint, before bigint")
    numbered = materialize(sorted_.join(offsets, F.shiftright("at", 33) == F.col("part")).select(F.col("ident").alias("_ident"), (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord")))
    return docs.join(numbered, F.col("ident") == F.col("_ident"), "left").select("ident", "text", F.coalesce("ord", F.lit(LAST)).alias("ord"))


@operator
def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50) -> DataFrame:
    """One row a document: its id (of any type with an order), n_bytes, n_removed, spans (begin and end of each maximal removed run, in bytes), kept (the other bytes).

    Texts are UTF-8, null is empty. A byte goes if a string of `window` bytes covers it that also starts in a document with a smaller id; strings don't cross documents
    and are judged on the input. Rows that repeat an id are one document's as far as that goes: they take nothing from each other. A null id is larger than all others, so such rows lose
    what others have and take nothing. kept may begin or end within a character, so it is binary. Texts may have any length that a row has (a text is one task's work).
    An empty table gives an empty result; other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if window < 2:
        raise ValueError("a window has two bytes at least")
    kind = docs.schema[id_column].dataType
    rows = _order(docs.select(F.col(id_column).alias("ident"), text_of(text_column).alias("text")), kind).withColumn("digest", F.sha2("text", 256))
    first = rows.groupBy("digest").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").select(F.col("digest").alias("of"), "least")
    first = materialize(first)
    copy = F.coalesce(F.col("ord") > F.col("least"), F.lit(False)).alias("copy")
    marked = rows.join(F.broadcast(first) if is_small(first) else first, F.col("digest") == F.col("of"), "left").select("ident", "ord", "text", copy)
    held = StructType().add("block", LongType()).add("idents", ArrayType(kind)).add("ords", ArrayType(LongType())).add("ends", ArrayType(LongType())).add("gone_idents", ArrayType(kind)).add("gone_bytes", ArrayType(LongType())).add("text", BinaryType())
    blocks = materialize(marked.mapInArrow(_blocks(window, to_arrow_schema(held)), held), group_bytes=16 * BLOCK_BYTES)
    discard(first)
    total = blocks.agg(F.coalesce(F.sum(F.try_element_at("ends", F.lit(-1))), F.lit(0))).first()[0]
    texts = blocks.select("block", "ords", "ends", "text")

    buckets = max(1, -(-int(total) // (8 * BUCKET_KEYS)))
    entries = texts.mapInArrow(_keys(window, buckets), "block bigint, bucket int, entries binary")
    flags = materialize(entries.groupBy("bucket").applyInArrow(_flags(HOT), "block bigint, bucket int, flags binary, rows bigint"))
    onward = flags.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    buckets = max(1, -(-int(onward) // BUCKET_ROWS))
    shared = flags.where("rows > 0").select("block").distinct()
    some = flags.join(shared, "block", "left_semi")
    shares = materialize(texts.groupBy("block").cogroup(some.groupBy("block")).applyInArrow(_shares(window, buckets), "block bigint, bucket int, docs binary, left binary, run binary, body binary"), group_bytes=16 * BLOCK_BYTES)
    discard(flags)
    masks = materialize(shares.where("bucket >= 0").groupBy("bucket").applyInArrow(_repeats(window), "block bigint, bucket int, body binary"))
    local = shares.where("bucket < 0").select("block", "bucket", F.lit(0).alias("kind"), "docs", "left", "run", "body")
    empty = F.lit(None).cast("binary")
    rest = local.union(masks.select("block", "bucket", F.lit(1).alias("kind"), empty.alias("docs"), empty.alias("left"), empty.alias("run"), "body"))
    found = StructType().add("ident", kind).add("n_bytes", LongType()).add("n_removed", LongType()).add("spans", ArrayType(StructType().add("begin", LongType()).add("end", LongType()))).add("kept", BinaryType())
    out = blocks.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(_results(window, to_arrow_schema(found)), found)
    return out.withColumnRenamed("ident", id_column)
