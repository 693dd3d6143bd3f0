"""Removal of long repeated passages by a compacted de Bruijn graph.

A window of 35 words is an edge of the graph between its first and last 34 words. Consecutive windows of a document that share the occurrence of
their least 10-word k-mer (the anchor) are one path from the start, so that about one row stands for a dozen edges, and only paths whose anchor occurs
again go on. Paths that repeat as a whole are found by a join. Where different paths meet in one anchor they are taken apart into their edges, one copy
of each path. Each repeated edge gets the degrees of its ends from the windows before and after all its occurrences; where an end has one edge in
and one out, consecutive edges of a document are compacted. Every compacted path keeps its own coordinates and those of another occurrence (the
witness); paths whose witnesses go on where they themselves do are compacted further. A path counts as repeated only if the words at its
coordinates are the words at its witness's, told by a digest of 128 bits of the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aranges, discard, materialize, operator, sequence_hashes, sequence_sums, signed, slabs, span_hashes, text_of, word_spans

#: Words of an anchor; any window of `window` words has window - ANCHOR + 1 of them.
ANCHOR = 10


def _least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values, the place of the least one, the leftmost of equals."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        have += step
    return at


def _words(data, offs):
    begin, end, first = word_spans(data, offs)
    return span_hashes(data, begin, end), first


def _paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, data, offs in slabs(batch.column(1), 1 << 18):
                words, first = _words(data, offs)
                count = np.maximum(np.diff(first) - window + 1, 0)
                start = aranges(first[:-1], count)
                if not len(start):
                    continue
                sums = sequence_sums(words)
                anchors = sequence_hashes(sums, np.arange(len(words) - ANCHOR + 1), ANCHOR)
                least = _least_positions(anchors, window - ANCHOR + 1)[start]
                head = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                run_ = np.diff(np.append(head, len(start)))
                row = np.repeat(np.arange(hi - lo), count)[head]
                at = start[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo + row]), pa.array((at - first[row]).astype(np.int32)), pa.array(run_.astype(np.int32)), signed(anchors[least[head]]), signed(sequence_hashes(sums, at, run_ + window - 1))],
                    ["key", "start", "run", "anchor", "path"],
                )

    return run


def _edges(window: int):
    """Rows (key, text, spans of (start, run, known)) to one row a window, with the windows before and after it (0: none); known: its repetition is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans = batch.column(0).to_numpy(), batch.column(2)
            ends = spans.offsets.to_numpy()
            start, many, known = (f.to_numpy(zero_copy_only=False) for f in spans.values.flatten())
            for lo, hi, data, offs in slabs(batch.column(1), 1 << 18):
                words, first = _words(data, offs)
                every = sequence_hashes(sequence_sums(words), np.arange(max(len(words) - window + 1, 0)), window)
                own = slice(ends[lo], ends[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                at = aranges(first[row] + start[own], many[own].astype(np.int64))
                each = np.repeat(row, many[own])
                before = np.where(at > first[each], every[np.maximum(at - 1, 0)], np.uint64(0))
                after = np.where(at + window < first[each + 1], every[np.minimum(at + 1, len(every) - 1)], np.uint64(0))
                yield pa.RecordBatch.from_arrays(
                    [signed(every[at]), pa.array(keys[lo + each]), pa.array((at - first[each]).astype(np.int32)), pa.array(np.repeat(known[own], many[own]).astype(bool)), signed(before), signed(after)],
                    ["edge", "key", "start", "known", "before", "after"],
                )

    return run


def _digests(window: int):
    """Rows (key, text, spans of (start, run)) to a row a span with the digest of its words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans = batch.column(0).to_numpy(), batch.column(2)
            ends = spans.offsets.to_numpy()
            start, many = (f.to_numpy() for f in spans.values.flatten())
            for lo, hi, data, offs in slabs(batch.column(1)):
                made = []
                for i in range(lo, hi):
                    words = data[offs[i - lo] : offs[i - lo + 1]].tobytes().split()
                    made += [blake2b(b" ".join(words[s : s + n + window - 1]), digest_size=16).digest() for s, n in zip(start[ends[i] : ends[i + 1]].tolist(), many[ends[i] : ends[i + 1]].tolist(), strict=True)]
                own = slice(ends[lo], ends[hi])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[lo:hi], np.diff(ends[lo : hi + 1]))), pa.array(start[own]), pa.array(many[own]), pa.array(made, pa.binary())], ["key", "start", "run", "words"])

    return run


def _cut(window: int):
    """Rows (ident, text, spans of (start, run)) to the counts and the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            ends, none = spans.offsets.to_numpy(), spans.is_null().to_numpy(zero_copy_only=False)
            start, many = (f.to_numpy() for f in spans.values.flatten())
            for lo, hi, data, offs in slabs(batch.column(1)):
                total, gone, kept = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), []
                for i in range(lo, hi):
                    words = data[offs[i - lo] : offs[i - lo + 1]].tobytes().split()
                    total[i - lo] = len(words)
                    if not none[i] and ends[i] < ends[i + 1]:
                        own = slice(ends[i], ends[i + 1])
                        edge = np.bincount(start[own], minlength=len(words) + 1)
                        edge -= np.bincount(start[own] + many[own] + window - 1, minlength=len(words) + 1)
                        stay = np.cumsum(edge[:-1]) == 0
                        gone[i - lo] = len(words) - int(stay.sum())
                        words = compress(words, stay.tolist())
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total), pa.array(gone), pa.array(kept, pa.binary()).cast(pa.string())], ["ident", "n_words", "n_removed", "kept_text"])

    return run


def _witness() -> tuple:
    """Another occurrence's coordinates: the first of all, or the last where a row is the first itself."""
    other = F.when(F.struct("key", "start") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    return other.key.alias("wkey"), other.start.alias("wstart")


def _occurrences() -> tuple:
    return F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("lo"), F.max(F.struct("key", "start")).alias("hi")


def _compact(rows: DataFrame, joined) -> DataFrame:
    """(key, start, run, wkey, wstart): rows of a document that follow each other without a gap become one where joined holds (previous values: p_*)."""
    order = Window.partitionBy("key").orderBy("start")
    before = rows.select("*", *[F.lag(c).over(order).alias(f"p_{c}") for c in rows.columns if c != "key"])
    goes_on = F.coalesce((F.col("p_start") + F.col("p_run") == F.col("start")) & joined, F.lit(False))
    parts = before.withColumn("part", F.sum(F.when(goes_on, 0).otherwise(1)).over(order))
    return parts.groupBy("key", "part").agg(F.min("start").alias("start"), F.sum("run").cast("int").alias("run"), F.min(F.struct("start", "wkey", "wstart")).alias("w")).select("key", "start", "run", "w.wkey", "w.wstart")


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """Of docs (key, text), a table with a key of its own for each row: (key, spans of (start, run)) with all windows whose words also start anywhere else."""
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    paths = materialize(docs.mapInArrow(_paths(window), "key bigint, start int, run int, anchor bigint, path bigint"))
    anchors = paths.groupBy("anchor").agg(F.count("*").alias("n"), F.min("path").alias("least"), F.max("path").alias("most")).where("n > 1")
    # A written table, not the aggregate itself, goes into the join: then a hot anchor's partition can be split.
    anchors = materialize(anchors.select("anchor", F.expr("least <> most").alias("branches")))
    shared = materialize(paths.join(anchors, "anchor").select("key", "start", "run", "path", "branches"))
    discard(paths)
    copies = materialize(shared.groupBy("path").agg(*_occurrences()))
    met = materialize(shared.join(copies, "path").select("key", "start", "run", "branches", "n", *_witness(), (F.struct("key", "start") == F.col("lo")).alias("one")))
    discard(shared)
    whole = _compact(met.where("n > 1").select("key", "start", "run", "wkey", "wstart"), (F.col("p_wkey") == F.col("wkey")) & (F.col("p_wstart") + F.col("p_run") == F.col("wstart")))
    open_ = met.where("branches AND one").groupBy("key").agg(F.collect_set(F.struct("start", "run", (F.col("n") > 1).alias("known"))).alias("spans"))
    edges = materialize(docs.join(open_, "key").select("key", "text", "spans").mapInArrow(_edges(window), "edge bigint, key bigint, start int, known boolean, before bigint, after bigint"))
    degrees = [F.when(F.min(c) == F.max(c), F.min(c)).alias(f"only_{c}") for c in ("before", "after")]
    graph = materialize(edges.groupBy("edge").agg(*_occurrences(), *degrees).where("n > 1"))
    single = edges.where("NOT known").select("edge", "key", "start").join(graph, "edge").select("key", "start", F.lit(1).alias("run"), *_witness(), "edge", "only_before", "only_after")
    # The witness must go on too: a copy that was left out may have gone on in another way.
    goes_on = (F.col("p_wkey") == F.col("wkey")) & (F.col("p_wstart") + 1 == F.col("wstart"))
    single = _compact(single, goes_on & (F.col("p_only_after") == F.col("edge")) & (F.col("only_before") == F.col("p_edge")))
    spans = materialize(whole.union(single))
    for used in (edges, graph, met):
        discard(used)
    asked = spans.select("key", "start", "run").union(spans.select("wkey", "wstart", "run")).groupBy("key").agg(F.collect_set(F.struct("start", "run")).alias("spans"))
    read = materialize(docs.join(asked, "key").select("key", "text", "spans").mapInArrow(_digests(window), "key bigint, start int, run int, words binary"))
    at_witness = read.select(F.col("key").alias("wkey"), F.col("start").alias("wstart"), "run", F.col("words").alias("again"))
    good = spans.join(read, ["key", "start", "run"]).join(at_witness, ["wkey", "wstart", "run"]).where("words = again")
    out = materialize(good.groupBy("key").agg(F.collect_set(F.struct("start", "run")).alias("spans")))
    discard(spans)
    discard(read)
    return out


@operator
def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35) -> DataFrame:
    """One row a document: its id (of any type), n_words, n_removed, kept_text.

    A word goes if a window of so many words covers it whose sequence also starts anywhere else, in any row, this one
    included; windows are judged on the input, whole texts of any length. Null and empty texts have no words; rows that repeat an id and a text are
    two places, so their windows all go. kept_text has the other words, joined by one space. An empty table gives an
    empty result; other columns are not looked at.
    """
    rows = materialize(docs.select(F.col(id_column).alias("ident"), text_of(text_column).alias("text")).withColumn("key", F.monotonically_increasing_id()))
    spans = repeated_spans(rows.select("key", "text"), window)
    id_type = docs.schema[id_column].dataType.simpleString()
    out = rows.join(spans, "key", "left").select("ident", "text", "spans").mapInArrow(_cut(window), f"ident {id_type}, n_words bigint, n_removed bigint, kept_text string")
    return out.withColumnRenamed("ident", id_column)
