"""Text quality by a sparse rule ensemble: rules from shallow boosted trees over text statistics, weighed by a lasso logistic fit.

The statistics are one numpy pass over a text; the fitted rules are compiled into one Spark column expression over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, operator, slabs, span_hashes, text_of, word_spans

#: Sampled labelled documents; trees, their depth, and the rows each is grown on.
SAMPLE, TREES, DEPTH, TREE_ROWS = 20_000, 30, 3, 4000
STATISTICS = ("words", "word_length", "capitals", "marks", "digits", "other_scripts", "distinct", "repeats", "lone_marks", "marked_ends", "lines", "line_words", "distinct_lines", "stops", "longest")

_KIND = np.zeros(256, np.uint8)  # 0 space or control, 1 small letter, 2 capital, 3 digit, 4 mark, 5 other scripts
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_ENDS = np.zeros(256, bool)  # marks that end a clause
_ENDS[[ord(c) for c in ".,;:?"]] = True


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty one."""
    rows = len(offs) - 1
    begin, end, first = word_spans(data, offs)
    words = np.diff(first).astype(float)
    row = np.repeat(np.arange(rows), np.diff(first))
    hashes = span_hashes(data, begin, end, lower=True)
    per = lambda which, of: np.bincount(of, which, rows)[:rows]
    each = np.maximum(words, 1)
    kind = _KIND[data]
    byte_row = np.repeat(np.arange(rows), np.diff(offs))
    kinds = np.bincount(byte_row * 6 + kind, minlength=rows * 6).reshape(rows, 6).astype(float)
    shown = np.maximum(kinds[:, 1:].sum(1), 1)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    same = np.zeros(len(row))
    same[1:] = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    last = data[end - 1] if len(end) else data[:0]
    lone = (end - begin == 1) & (kind[begin] == 4) if len(begin) else np.zeros(0, bool)
    marked = (_KIND[last] == 4) & ~_ENDS[last]
    l_begin, l_end, l_first = word_spans(data, offs, _NEWLINE)
    lines = np.diff(l_first).astype(float)
    l_row = np.repeat(np.arange(rows), np.diff(l_first))
    l_hash = span_hashes(data, l_begin, l_end)
    l_order = np.lexsort((l_hash, l_row))
    l_new = np.ones(len(l_order), bool)
    l_new[1:] = (l_row[l_order][1:] != l_row[l_order][:-1]) | (l_hash[l_order][1:] != l_hash[l_order][:-1])
    longest = np.zeros(rows)
    np.maximum.at(longest, row, (end - begin).astype(float))
    columns = [
        words, per((end - begin).astype(float), row) / each, kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1), kinds[:, 4] / shown, kinds[:, 3] / shown, kinds[:, 5] / shown,
        per(new.astype(float), row[order]) / each, per(same, row) / each, per(lone.astype(float), row) / each, per(marked.astype(float), row) / each, lines, words / np.maximum(lines, 1),
        per(l_new.astype(float), l_row[l_order]) / np.maximum(lines, 1), per(_ENDS[last].astype(float), row) / each, np.minimum(longest, 1000),
    ]
    return np.stack(columns, 1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in slabs(batch.column(1)):
            x = statistics(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1]))], ["ident", *STATISTICS])


def measure(rows: DataFrame) -> DataFrame:
    """Of (ident, text): (ident, statistics)."""
    kind = rows.schema["ident"].dataType.simpleString()
    return rows.select("ident", "text").mapInArrow(_measured, f"ident {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # conditions: statistic, above (else at most), cut


def grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule = (), out: list | None = None) -> list[tuple[Rule, np.ndarray]]:
    """All paths of a regression tree, inner nodes included, and the rows they take in."""
    out = [] if out is None else out
    best, total, n = (0.0, -1, 0.0), residual.sum(), len(residual)
    for j in range(x.shape[1]) if depth and n >= 20 else ():
        if not len(cuts[j]):
            continue
        at = np.searchsorted(cuts[j], x[:, j])  # rows with at <= k are at most cuts[k]
        sums, counts = (np.cumsum(np.bincount(at, w, len(cuts[j]) + 1))[:-1] for w in (residual, None))
        fine = (counts >= 5) & (n - counts >= 5)
        gain = np.where(fine, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-9:
            best = (gain[k], j, cuts[j][k])
    if best[1] >= 0:
        _, j, cut = best
        above = x[:, j] > cut
        for side in (False, True):
            own = above if side else ~above
            rule = (*path, (j, side, float(cut)))
            out.append((rule, residual[own].mean()))
            grow(x[own], residual[own], cuts, depth - 1, rule, out)
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    good = np.ones(len(x), bool)
    for j, above, cut in rule:
        good &= (x[:, j] > cut) == above
    return good


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient; the bias is not penalised."""
    n = len(y)
    r1 = np.column_stack((r, np.ones(n)))
    rate = 4 * n / max(np.linalg.norm(r1, 2) ** 2, 1e-9)
    w = z = np.zeros(r1.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(r1 @ z, -50, 50)))
        new = z - rate * (r1.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    bias: float

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            met = None
            for j, above, cut in rule:
                c = F.col(STATISTICS[j])
                one = c > cut if above else c <= cut
                met = one if met is None else met & one
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-50.0)), F.lit(50.0))))


def train_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4, seed: int = 3) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel([], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        own = rng.choice(len(y), min(TREE_ROWS, len(y)), replace=False)
        for rule, value in grow(x[own], residual[own], cuts, DEPTH):
            rules.setdefault(rule, None)
            if len(rule) == DEPTH:
                margin += np.where(holds(rule, x), 2 * value, 0)
    rules = list(rules)
    met = np.array([holds(r, x) for r in rules], float).T.reshape(len(y), len(rules))
    weights, bias = lasso_logistic(met, y, penalty)
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], bias)


@operator
def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> RuleModel:
    """Rules and weights from about SAMPLE labelled documents, whose ids learn allows.

    Null labels and ids teach nothing; of an id's labels the greatest counts; an id's rows all teach; null texts count as empty, texts are measured whole.
    From one class only, or from empty tables, the model is a bias alone. Columns beyond the named ones are not looked at.
    """
    sample = labelled_sample(docs, labels, label, SAMPLE, learn, id_column, text_column)
    got = measure(sample.select(F.col("label").alias("ident"), "text"))
    table = got.toArrow().to_pandas().sort_values([*STATISTICS, "ident"])
    return train_rules(table[list(STATISTICS)].to_numpy(), table["ident"].to_numpy(dtype=float))


@operator
def score_quality(docs: DataFrame, model: RuleModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for each row, 0 to 1; null texts count as empty, texts are measured whole. Repeated rows and null ids are kept, empty tables give empty results, other
    columns are not looked at."""
    stats = measure(docs.select(F.col(id_column).alias("ident"), text_of(text_column).alias("text")))
    return stats.select(F.col("ident").alias(id_column), model.column().alias("score"))
