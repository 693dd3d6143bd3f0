from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lensaudit.llm import exact_dedup as exact_module
from lensaudit.llm import minhash_dedup
from lensaudit.llm.components import components
from lensaudit.llm.embedding_dedup import near_vectors
from lensaudit.llm.exact_dedup import CuckooIndex, digest, drop_copies, exact_dedup, live_index
from lensaudit.llm.minhash_dedup import drop_near_copies, near_duplicates
from lensaudit.llm.substring_dedup import substring_dedup

from .helpers import SHAPE, WORDS, frame, odd_rows


def norm(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        self.up[self.root(a)] = self.root(b)


# --- exact ---


def test_cuckoo_inserts_deletes_and_grows():
    index, keys = CuckooIndex(2), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    assert all(index.insert(k, i) for i, k in enumerate(keys))
    assert not index.insert(keys[5], 1) and index.find(keys[5])[1:] == [2, 1]
    assert index.mask + 1 > 2 and len(index) == 3000 == len(list(index))
    assert all(index.delete(k) for k in keys[:1000]) and not index.delete(keys[0])
    assert index.find(keys[5])[1] == 1  # one of its two copies is still live
    assert all(index.find(k) is None for k in keys[:1000] if k != keys[5]) and all(index.find(k) for k in keys[1000:])
    assert index.insert(keys[0], 9) and index.find(keys[0])[1:] == [1, 9]


def test_cuckoo_tells_keys_with_one_fingerprint_apart():
    a, b = bytes([1]) * 10 + b"a" * 22, bytes([1]) * 10 + b"b" * 22
    index = CuckooIndex()
    index.insert(a, 1)
    assert index.find(b) is None and not index.delete(b)
    index.insert(b, 2)
    index.delete(a)
    assert index.find(a) is None and index.find(b)[2] == 2


def test_exact_dedup_against_plain_grouping(spark):
    rows = odd_rows()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[norm(text)].append(i)
    expected = []
    for i, text, *_ in rows:
        own = groups[norm(text)]
        keep = min((x for x in own if x is not None), default=None)
        expected.append((i, keep, len(own), i == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_drop_copies_keeps_one_row_of_each_text(spark):
    docs = frame(spark, odd_rows())
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [norm(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {norm(r[1]) for r in odd_rows()}
    assert drop_copies(frame(spark, [])).count() == 0


def test_live_index_deletes(spark):
    docs = frame(spark, [(1, "a", "", ""), (2, "a", "", ""), (3, "b", "", ""), (4, "c", "", "")])
    keyed = docs.select(F.unhex(digest()).alias("digest"), F.col("doc_id").alias("ident"))
    gone = frame(spark, [(0, "a", "", ""), (0, "b", "", ""), (0, "unknown", "", "")]).select(F.unhex(digest()).alias("digest"))
    assert sorted((r["ident"], r["copies"]) for r in live_index(keyed, gone).collect()) == [(1, 1), (4, 1)]


# --- components ---


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (2, 3)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 300)] + [(500, 501)], [(7, 3), (3, 9), (9, -4), (20, 30)]])
def test_components_against_union_find(spark, edges):
    plain = Union()
    for a, b in edges:
        plain.link(a, b)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    least = {}
    for x in sorted(nodes):
        least.setdefault(plain.root(x), x)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: least[plain.root(x)] for x in nodes}


# --- near copies ---


def sets_of(text, k):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORDS.findall(text or "")]
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def plain_groups(rows, k, percent=80):
    sets, plain = [sets_of(r[1], k) for r in rows], Union()
    for i in range(len(rows)):
        plain.root(i)
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                plain.link(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            x = plain.root(i)
            least[x] = min(least.get(x, r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(plain.root(i)), r[0] == least.get(plain.root(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    rows = odd_rows()
    got = [tuple(r) for r in near_duplicates(frame(spark, rows), k=k).collect()]
    assert sorted(got, key=repr) == sorted(plain_groups(rows, k), key=repr)
    assert near_duplicates(frame(spark, [])).count() == 0


def chain_rows(n=60):
    """Copies that differ from their neighbours in one word more each: links go along the chain, not to its hub."""
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(n):
        words[(7 * i) % 90] = f"new{i}"
        rows.append((1000 - i, " ".join(words), "en", "s"))
    return rows


def test_classes_that_hubs_leave_apart_are_found(spark):
    rows = chain_rows()
    got = [tuple(r) for r in near_duplicates(frame(spark, rows), k=4).collect()]
    assert sorted(got) == sorted(plain_groups(rows, 4))


def test_near_tied_partners_and_shared_passages(spark):
    """Sets around the threshold that share a long passage: each pair has many near-tied partners, of which only some are linked."""
    rng, passage = np.random.default_rng(5), [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"d{i % 30}x{j}" for j in range(14)]
        for _ in range(i % 3):
            own[int(rng.integers(14))] = f"e{i}"
        rows.append((i, " ".join(passage + own if i % 2 else own + passage), "en", "s"))
    got = [tuple(r) for r in near_duplicates(frame(spark, rows), k=4).collect()]
    assert sorted(got) == sorted(plain_groups(rows, 4))


def test_rarest_shingles_bring_every_linked_pair_together():
    """The lossless part of the second search: two sets of 80 % or more share one of their rarest shingles, whatever the counts say."""
    rng = np.random.default_rng(7)
    counts = type("Shared", (), {"value": rng.integers(0, 5, 1 << minhash_dedup.COUNTED_BITS)})
    for n in (1, 2, 5, 9, 40, 333):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for gone in range(n):
            other = np.sort(np.concatenate((base[gone:], rng.integers(0, 2**63, gone // 2, dtype=np.uint64))))
            shared, union = n - gone, n + gone // 2
            sets = pa.array([base.view(np.int64), other.view(np.int64)], pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), sets], ["cls", "comp", "items"])
            rows = [b.to_pydict() for b in minhash_dedup._rarest(counts, 80)(iter([batch]))]
            assert 100 * shared < 80 * union or set(rows[0]["item"]) & set(rows[1]["item"])


def test_sets_of_one_digest_only_are_one_class(spark, monkeypatch):
    """Sums and exclusive ors of shingles can agree by chance; the digest takes in the whole sorted set, and ids may be of any type."""
    items = np.array([1, 2, 3, 1, 2, 4, 5, 6], np.uint64)
    a, b, c = minhash_dedup._digests(items, np.array([0, 3, 6, 8])).to_pylist()
    assert len({a, b, c}) == 3 and all(len(x) == 16 for x in (a, b, c))
    df = spark.createDataFrame([("b", "one two three four five"), ("a", "One two three four FIVE"), (None, "one two three four five"), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, near_duplicates(df, k=4).collect()), key=repr) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 0, "c", True), (None, 2, "a", False)]
    assert sorted(r["keep_id"] for r in exact_dedup(df).collect()) == ["a", "b", "b", "c"]
    assert {r["doc_id"] for r in drop_copies(df).collect()} == {"a", "b", "c"} and {r["doc_id"] for r in drop_near_copies(df, k=4).collect()} == {"a", "c"}


def test_indexes_are_handed_on_when_full(spark, monkeypatch):
    monkeypatch.setattr(exact_module, "SHARD_KEYS", 10)
    rows = [(i, f"text {i % 40}", "", "") for i in range(200)]
    out = exact_dedup(frame(spark, rows)).collect()
    assert all(r["group_size"] == 5 and r["keep_id"] == r["doc_id"] % 40 for r in out) and len(out) == 200
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) * 32 for i in range(25)]), pa.array(range(25)), pa.array([1] * 25)], ["digest", "ident", "copies"])
    parts = list(exact_module._index(False)(iter([batch.slice(0, 12), batch.slice(12)])))
    assert [p.num_rows for p in parts] == [12, 13]


def test_dropping_copies_doesnt_depend_on_the_layout(spark):
    rows = [(i % 50, f"text {i % 20}", "en", "s") for i in range(300)]
    docs = frame(spark, rows)
    for laid in (docs, docs.repartition(7), docs.orderBy(F.rand(3))):
        assert sorted((r["doc_id"], r["text"]) for r in drop_copies(laid).collect()) == sorted((i % 10, f"text {i}") for i in range(20))


def test_drop_near_copies_keeps_one_of_each_group(spark):
    rows = [r for r in odd_rows()] + chain_rows(12)
    docs = frame(spark, rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    groups, expected = plain_groups(rows, 5), set()
    for r, (ident, size, component, own) in zip(rows, groups, strict=True):
        if own or not size or component is None:
            expected.add((ident, r[1]))
    assert set(got) == expected
    assert all(n == 1 for (i, t), n in got.items() if sets_of(t, 5))
    assert drop_near_copies(frame(spark, [])).count() == 0


# --- vectors ---


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    from lensaudit.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "LEAF", 40)
    monkeypatch.setattr(embedding_dedup, "BIG", 100)
    monkeypatch.setattr(embedding_dedup, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 70)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 32))
    vectors = [c + rng.standard_normal(32) * s for c in centres for s in rng.choice([0.02, 0.15, 0.3], 8)]
    vectors += [vectors[0]] * 40 + [2 * vectors[9], np.zeros(32), vectors[3][:20]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [None] * 32), (903, [float("nan")] * 32), (904, [math.inf] + [1.0] * 31), (None, rows[5][1]), (7, rows[7][1])]
    usable = [v if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v in rows]
    plain, links = Union(), Counter()
    for i, a in enumerate(usable):
        plain.root(i)
        for j in range(i):
            b = usable[j]
            if a and b and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                plain.link(i, j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[plain.root(i)] = min(least.get(plain.root(i), ident), ident)
    expected = [(ident, links[i], least.get(plain.root(i)), ident == least.get(plain.root(i))) for i, (ident, _) in enumerate(rows)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, links int, cls string")
    got = [tuple(r) for r in near_vectors(df).collect()]
    # Vectors of exactly one direction may miss equality by rounding only, far from 0.95.
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("width, size, leaf", [(64, 60_000, 128), (256, 20_000, 40)])
def test_recall_of_deep_trees(width, size, leaf):
    """Pairs at a cosine of 0.95 to 0.96 among many other vectors, in trees of some eight levels and more."""
    from lensaudit.llm import embedding_dedup as module

    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((size, width)) + 0.8 * rng.standard_normal((30, width))[rng.integers(0, 30, size)])
    first, away = base[:2000], unit(rng.standard_normal((2000, width)))
    away = unit(away - (away * first).sum(1, keepdims=True) * first)
    cosine = rng.uniform(0.95, 0.96, (2000, 1))
    second = cosine * first + np.sqrt(1 - cosine**2) * away
    overlap = 0.5 * np.sqrt(0.1 / width)
    sample = base[rng.choice(size, 8192, replace=False)]
    met, held, depth = np.zeros(2000, bool), [], []
    for t in range(module.TREES):
        tree = module.fit_tree(sample, size / len(sample), overlap, [t, 5], leaf)
        of = [np.split(leaves[np.argsort(rows, kind="stable")], np.cumsum(np.bincount(rows, minlength=2000))[:-1]) for rows, leaves in (tree.leaves(first), tree.leaves(second))]
        met |= np.array([bool(set(a) & set(b)) for a, b in zip(*of, strict=True)])
        sizes = np.bincount(tree.leaves(base)[1])
        held.append(sizes.sum() / size)
        depth.append(np.log2(size / np.median(sizes[sizes > 0])))
    assert met.mean() >= 0.97 and min(depth) >= 8, (met.mean(), held, depth)


# --- passages ---


def plain_cut(rows, window):
    words = [WORDS.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup_against_all_windows(spark, window):
    rows = odd_rows() + chain_rows(8)
    got = [tuple(r) for r in substring_dedup(frame(spark, rows), window=window).collect()]
    assert sorted(got, key=repr) == sorted(plain_cut(rows, window), key=repr)
    assert substring_dedup(frame(spark, [])).count() == 0


def test_shape_has_clashing_names():
    assert "key" in SHAPE and "kept" in SHAPE
