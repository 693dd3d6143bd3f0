"""Scoring by a Brown class bigram model.

Counts of all tokens of the corpus stay a table, keyed by a token's hash. Classes are found in two steps. The driver exchanges items: the WORDS most
frequent words, and one item for each shape (hash of the last two bytes) of all others. Then a distributed pass gathers, for each further word of
the training rows, however rare, the classes before and after it, takes the word out of its shape's class and puts it into its best one.
Only words that no training row has keep their shape's class. P(w | before) = P(class | class before) * P(w | class), transitions counted over the
final classes with Witten-Bell smoothing, emissions by half a count added, with room for one unknown word a shape. What reaches the driver and is
broadcast is bounded by WORDS, KNOWN and SHAPES; all other words' counts and classes come by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, materialize, operator, signed, slabs, span_hashes, text_of, word_spans

#: Words that the driver clusters; words whose counts and classes are broadcast; shapes of the others; classes.
WORDS, KNOWN, SHAPES, CLASSES = 768, 131_072, 256, 64
#: The end of a text, as a token and as an item.
END, END_ITEM = np.uint64(0), WORDS + SHAPES
ITEMS = END_ITEM + 1
#: Tokens that a task counts before it hands counts on.
_FLUSH = 4_000_000
#: Contexts that are scored at once; counts up to which gains are looked up. Marks of a byte of classes: a word to be joined, and one not found.
_CHUNK, _SMALL, _RARE, _UNSEEN = 1 << 15, 16, 128, 255


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of all tokens, each row's end included, and where rows begin in them (rows + 1)."""
    begin, end, first = word_spans(data, offs)
    rows = len(offs) - 1
    at = np.arange(len(begin)) + np.repeat(np.arange(rows), np.diff(first))
    hashes, shapes = np.full(len(begin) + rows, END), np.zeros(len(begin) + rows, np.int16)
    hashes[at] = span_hashes(data, begin, end, lower=True)
    low = ASCII_LOWER[data]
    last, other = low[end - 1].astype(np.uint32), np.where(end - begin > 1, low[np.maximum(end - 2, 0)] if len(end) else 0, 0).astype(np.uint32)
    shapes[at] = ((last * 257 + other) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int16) % SHAPES
    return hashes, shapes, first + np.arange(rows + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []

    def flush():
        tokens, at, n = np.unique(np.concatenate([h for h, _ in held]), return_index=True, return_counts=True)
        shapes = np.concatenate([s for _, s in held])[at]
        held.clear()
        for lo in range(0, len(tokens), 100_000):
            own = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([signed(tokens[own]), pa.array(shapes[own]), pa.array(n[own])], ["token", "shape", "n"])

    for batch in batches:
        for _, _, data, offs in slabs(batch.column(0)):
            held.append(_tokens(data, offs)[:2])
            if sum(len(h) for h, _ in held) >= _FLUSH:
                yield from flush()
    if held:
        yield from flush()


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _items(hashes: np.ndarray, shapes: np.ndarray, words: np.ndarray) -> np.ndarray:
    at, there = _place(words, hashes)
    return np.where(hashes == END, END_ITEM, np.where(there, at, WORDS + shapes))


def _pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ITEMS * ITEMS, np.int64)
        for batch in batches:
            for _, _, data, offs in slabs(batch.column(0)):
                hashes, shapes, _ = _tokens(data, offs)
                items = _items(hashes, shapes, shared.value)
                before = np.concatenate(([END_ITEM], items[:-1]))
                total += np.bincount(before * ITEMS + items, minlength=len(total))
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 100_000]), pa.array(total[at[lo : lo + 100_000]])], ["pair", "n"])

    return run


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(counts: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """A class for each item of a square matrix of bigram counts, by exchanges that raise the classes' mutual information."""
    items = len(counts)
    counts = counts.astype(np.float64)
    order = np.argsort(-counts.sum(0), kind="stable")
    label = np.empty(items, np.int64)
    label[order] = np.arange(items) % classes
    one = np.eye(classes)[label]
    ahead, back = counts @ one, one.T @ counts  # item -> class, class -> item
    between = one.T @ ahead
    rows, cols = counts.sum(1), counts.sum(0)
    diag = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not rows[w] + cols[w]:
                continue
            c, own = label[w], counts[w, w]
            out, into = ahead[w].copy(), back[:, w].copy()
            out[c] -= own
            into[c] -= own
            between[c] -= ahead[w]
            between[:, c] -= back[:, w]
            between[c, c] += own
            left, right = between.sum(1) + into, between.sum(0) + out
            gain = (_h(between + out) - _h(between)).sum(1) + (_h(between + into[:, None]) - _h(between)).sum(0)
            self_ = between[diag, diag]
            gain += _h(self_ + out + into + own) - _h(self_ + out) - _h(self_ + into) + _h(self_)
            gain -= _h(left + rows[w]) - _h(left) + _h(right + cols[w]) - _h(right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            between[best] += out
            between[:, best] += into
            between[best, best] += own
            if best != c:
                label[w], moved = best, moved + 1
                ahead[:, c] -= counts[:, w]
                ahead[:, best] += counts[:, w]
                back[c] -= counts[w]
                back[best] += counts[w]
        if not moved:
            break
    return label


def _contexts(shared):
    """Of each word beyond the most frequent: its shape with the classes before and after (shape, before, after as digits), counted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, label = shared.value
        held: list = []

        def flush():
            tokens, context = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((context, tokens))
            tokens, context = tokens[order], context[order]
            at = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (context[1:] != context[:-1]))))
            n = np.diff(np.append(at, len(tokens)))
            for lo in range(0, len(at), 100_000):
                own = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([signed(tokens[at[own]]), pa.array(context[at[own]]), pa.array(n[own])], ["token", "context", "n"])

        for batch in batches:
            for _, _, data, offs in slabs(batch.column(0)):
                hashes, shapes, _ = _tokens(data, offs)
                items = _items(hashes, shapes, words)
                classes = label[items]
                at = np.flatnonzero((items >= WORDS) & (items < END_ITEM))
                before = np.where(at > 0, classes[at - 1], label[END_ITEM])
                held.append((hashes[at], ((shapes[at].astype(np.int64) * CLASSES + before) * CLASSES + classes[at + 1]).astype(np.int32)))
                if sum(len(h) for h, _ in held) >= _FLUSH:
                    yield from flush()
        if sum(len(h) for h, _ in held):
            yield from flush()

    return run


class Assigner:
    """Moves words one by one out of their shapes' classes into their best, the classes of all others held fixed.

    The gain is that of exchange_classes() where the words before and after keep their classes: a sum over the counted contexts.
    """

    def __init__(self, between: np.ndarray, shape_label: np.ndarray):
        #: Contexts (class before, then class after) by the class in the middle.
        self.beside = np.vstack((between, between.T)).astype(np.float64)
        self.before, self.after = between.sum(0).astype(np.float64), between.sum(1).astype(np.float64)
        self.label = shape_label
        n = np.arange(_SMALL + 1)[:, None, None]
        self.gains = _h(self.beside[None] + n) - _h(self.beside)[None]

    def assign(self, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shape, count and class of words 0, 1, ...; word: the ascending word of each context."""
        words = int(word[-1]) + 1
        shape = context[np.searchsorted(word, np.arange(words))] // (CLASSES * CLASSES)
        before, after = context // CLASSES % CLASSES, context % CLASSES
        counts = np.bincount(np.concatenate((word * 2 * CLASSES + before, word * 2 * CLASSES + CLASSES + after)), np.concatenate((n, n)), words * 2 * CLASSES)
        at = np.flatnonzero(counts)
        of, slot, m = at // (2 * CLASSES), at % (2 * CLASSES), counts[at]
        gain = self.gains[np.minimum(m, _SMALL).astype(np.int64), slot]
        many = np.flatnonzero(m > _SMALL)
        gain[many] = _h(self.beside[slot[many]] + m[many, None]) - _h(self.beside[slot[many]])
        first = np.searchsorted(of, np.arange(words))
        total = np.bincount(word, n, words)[:, None]
        gain = np.add.reduceat(gain, first) - (_h(self.before + total) - _h(self.before)) - (_h(self.after + total) - _h(self.after))
        own, total = self.label[shape], total[:, 0]
        there = self.beside[slot, own[of]]
        stay = np.add.reduceat(_h(there) - _h(there - m), first) - (_h(self.before[own]) - _h(self.before[own] - total)) - (_h(self.after[own]) - _h(self.after[own] - total))
        gain[np.arange(words), own] = stay
        best = gain.argmax(1)
        return shape, total.astype(np.int64), np.where(gain[np.arange(words), best] > stay + 1e-9, best, own)


def _assign(shared):
    """Contexts, sorted by token, to a row a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Assigner(*shared.value)

        def settle(token, context, n):
            new = np.concatenate(([True], token[1:] != token[:-1]))
            shape, total, cls = model.assign(np.cumsum(new) - 1, context, n)
            return pa.RecordBatch.from_arrays([pa.array(token[new]), pa.array(shape.astype(np.int16)), pa.array(total), pa.array(cls.astype(np.int16))], ["token", "shape", "n", "cls"])

        held = None
        for batch in batches:
            new = tuple(batch.column(i).to_numpy() for i in range(3))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            while len(held[0]) > _CHUNK:
                starts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1  # the last token may go on in the next batch
                if not len(starts):
                    break
                cut = int(starts[max(np.searchsorted(starts, _CHUNK, "right") - 1, 0)])
                yield settle(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[0]):
            yield settle(*held)

    return run


def _encode(shared):
    """Classes as bytes; a word whose count isn't broadcast has its shape's class plus _RARE and is in rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_log, known_label, shape_label = shared.value
        for batch in batches:
            for lo, hi, data, offs in slabs(batch.column(1)):
                hashes, shapes, first = _tokens(data, offs)
                at, there = _place(known, hashes)
                log = np.where(there, known_log[at], 0.0) if len(known) else np.zeros(len(at))
                classes = shape_label[shapes] + _RARE
                classes = (np.where(there, known_label[at], classes) if len(known) else classes).astype(np.uint8)
                classes[(hashes == END) & ~there] = shape_label[-1] + _RARE
                starts, row = first[:-1], np.repeat(np.arange(hi - lo), np.diff(first))
                rare = np.flatnonzero(~there)
                ends = np.searchsorted(row[rare], np.arange(hi - lo + 1))
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(hashes[rare]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.add.reduceat(there.astype(np.int64), starts)), pa.array(np.add.reduceat(log, starts)), _binary(classes, first), tokens],
                    ["ident", "held_out", "n_known", "log_counts", "classes", "rare"],
                )

    return run


def _binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the joined words' classes (place among the row's rare words * 256 + class) where their marks are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marked, offs = _classes(batch.column(4))
        found = batch.column(5)
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
        found = found.flatten().to_numpy().astype(np.int64)
        rare = np.flatnonzero(marked >= _RARE)
        at, cls = rare[np.searchsorted(rare, offs[row]) + found // 256], found % 256
        classes = np.where(marked >= _RARE, marked - np.uint8(_RARE), marked)
        seen = cls != _UNSEEN
        classes[at[seen]] = cls[seen]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(offs)), _binary(classes, offs)], ["ident", "held_out", "n_known", "log_counts", "n_tokens", "classes"])


def _moves(end: int):
    """Counts of pairs of classes; a row's first word follows an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            if batch.num_rows:
                classes = _classes(batch.column(0))[0].astype(np.int64)
                total += np.bincount(np.concatenate(([end], classes[:-1])) * CLASSES + classes, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pair", "n"])

    return run


def _model(between: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the transitions (classes x classes), and for each class log10 of the sum its emissions are divided by.

    types: distinct words of each class, unknown ones included.
    """
    total = between.sum(1, keepdims=True)
    prior = (between.sum(0) + 0.5) / (between.sum() + 0.5 * CLASSES)
    seen = (between > 0).sum(1, keepdims=True)
    moves = np.where(total > 0, (between + seen * prior) / np.maximum(total + seen, 1), prior)
    return np.log10(moves), np.log10(np.maximum(between.sum(0) + 0.5 * types, 0.5))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, moves, mass = shared.value
        for batch in batches:
            if batch.num_rows:
                classes, offs = _classes(batch.column(5))
                model = moves[np.concatenate(([end], classes[:-1])), classes] - mass[classes]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.add.reduceat(model, offs[:-1]))], ["ident", "held_out", "n_known", "log_counts", "n_tokens", "model"])

    return run


def _pair_matrix(found: DataFrame, side: int) -> np.ndarray:
    pairs = np.zeros(side * side)
    table = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return pairs.reshape(side, side)


@operator
def brown_scores(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: its id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    The model learns from the documents where held_out is false, and scores all. A null or empty text is its end alone. base_score is the
    unigram model with half a count added and one unknown word. Repeated rows and null ids are scored as any other, texts of any length whole; nothing to learn
    from leaves all tokens unknown; an empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("ident"), text_of(text_column).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = rows.where("NOT held_out").select("text")
    vocabulary = materialize(learn.mapInArrow(_count, "token bigint, shape smallint, n bigint").groupBy("token").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The counts from which no more than KNOWN words have as many, found by a coarse histogram.
    level = F.floor(F.log2("n") * 64).cast("int")
    least, so_far = 1 << 30, 0
    for r in sorted(vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        so_far += r["n"]
        if so_far > KNOWN:
            break
        least = r["level"]
    # The end of a text always, and the words to be clustered, however rare they are.
    first = vocabulary.where("token <> 0").orderBy(F.desc("n"), "token").limit(WORDS).toArrow()
    top = vocabulary.where((level >= least) | (F.col("token") == 0)).toArrow()
    words = np.sort(first.column("token").to_numpy().view(np.uint64))
    token, at = np.unique(np.concatenate([t.column("token").to_numpy() for t in (first, top)]), return_index=True)
    n = np.concatenate([t.column("n").to_numpy() for t in (first, top)])[at]
    order = np.argsort(token.view(np.uint64))
    known, known_n = token.view(np.uint64)[order], n[order]
    pairs = _pair_matrix(learn.mapInArrow(_pairs(spark.sparkContext.broadcast(words)), "pair bigint, n bigint"), ITEMS)
    label = exchange_classes(pairs, CLASSES)
    discard(vocabulary)
    one = np.eye(CLASSES)[label]
    end, shape_label = int(label[END_ITEM]), label[WORDS:ITEMS]
    contexts = learn.mapInArrow(_contexts(spark.sparkContext.broadcast((words, label))), "token bigint, context int, n bigint")
    # Tasks' counts are added up first, so that a word has at most a row for each shape and pair of classes beside it, however often it occurs.
    contexts = contexts.groupBy("token", "context").agg(F.sum("n").alias("n")).repartition("token").sortWithinPartitions("token")
    others = materialize(contexts.mapInArrow(_assign(spark.sparkContext.broadcast((one.T @ pairs @ one, shape_label))), "token bigint, shape smallint, n bigint, cls smallint"))
    known_label = np.full(len(known), end)
    at, there = _place(words, known)
    known_label[there] = label[at[there]]
    top = others.where(level >= least).select("token", "cls").toArrow()
    known_label[_place(known, top.column("token").to_numpy().view(np.uint64))[0]] = top.column("cls").to_numpy()
    shared = spark.sparkContext.broadcast((known, np.log10(known_n + 0.5), known_label, shape_label))
    kind = docs.schema[id_column].dataType.simpleString()
    coded = rows.select("ident", "text", "held_out").mapInArrow(_encode(shared), f"ident {kind}, held_out boolean, n_known bigint, log_counts double, classes binary, rare array<bigint>")
    coded = materialize(coded.withColumn("row", F.monotonically_increasing_id()))
    looked = coded.select("row", F.posexplode("rare").alias("at", "token")).join(others.select("token", "n", "cls"), "token", "left")
    by_row = looked.groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.collect_list(F.col("at").cast("bigint") * 256 + F.coalesce("cls", F.lit(_UNSEEN))).alias("found"))
    joined = coded.drop("rare").join(by_row, "row", "left")
    joined = joined.select("ident", "held_out", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("log_counts") + F.coalesce("logs", F.lit(0.0))).alias("log_counts"), "classes", "found")
    counted = "ident {}, held_out boolean, n_known bigint, log_counts double, n_tokens bigint".format(kind)
    placed = materialize(joined.mapInArrow(_settle, counted + ", classes binary"))
    between = _pair_matrix(placed.where("NOT held_out").select("classes").mapInArrow(_moves(end), "pair bigint, n bigint"), CLASSES)
    types = np.bincount(np.concatenate((label[: len(words)], shape_label)), minlength=CLASSES)
    for r in others.groupBy("cls").agg(F.count("*").alias("n")).collect():
        types[r["cls"]] += r["n"]
    scored = placed.mapInArrow(_score(spark.sparkContext.broadcast((end, *_model(between, types)))), counted + ", model double")
    base = math.log10(total + 0.5 * (distinct + 1))
    return scored.select(
        F.col("ident").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * base).alias("base_score"), (F.col("model") + F.col("log_counts")).alias("score"),
    )
