"""Substring removal by merged transforms, the prefix trie and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lensaudit.llm import centroids as centroids_module
from lensaudit.llm.centroids import Centroids, nearest_centroids, pack, quantise, unpack
from lensaudit.llm import suffix_dedup as suffix_module
from lensaudit.llm.prefix_trie import prefix_trie
from lensaudit.llm.suffix_dedup import merged, suffix_dedup, symbols, transform

from .helpers import frame, odd_rows

sha = lambda x: hashlib.sha256(x).hexdigest()


# --- substrings ---


def plain_removal(rows, window):
    """rows: (id, text, ...) to (id, bytes, removed, spans, kept)."""
    least, key = {}, lambda i: (i is None, i or 0)
    for i, text, *_ in rows:
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w not in least or key(i) < least[w]:
                least[w] = key(i)
    out = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < key(i):
                gone[p : p + window] = b"\1" * window
        edges = [p for p in range(len(b) + 1) if (p < len(b) and gone[p]) != (p > 0 and gone[p - 1] == 1)]
        out.append((i, len(b), sum(gone), tuple(zip(edges[::2], edges[1::2], strict=True)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def removal(df, window, **names):
    return sorted(((r[0], r.n_bytes, r.n_removed, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in suffix_dedup(df, window=window, **names).collect()), key=repr)


def passages(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(4)]
        for p in range(3):
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randrange(len(s) // 2)
                parts.insert(p, s[a : rng.randrange(a, len(s))])
        rows.append((rng.randrange(n), " ".join(parts), "en", "s"))
    return rows + [(3 * n + i, "x" * (30 * i), "en", "s") for i in range(5)] + [(4 * n, "ab" * 100, "en", "s"), (4 * n + 1, "ba" * 100, "en", "s"), (4 * n + 2, "a\0b" * 40, "en", "s"), (4 * n + 3, "\0" * 90, "en", "s"), (4 * n + 4, "\0" * 70, "en", "s")]


@pytest.mark.parametrize("window", [2, 7, 50, 51])
def test_suffix_dedup_against_plain_windows(spark, window):
    rows = odd_rows() + passages(window, 40)
    assert removal(frame(spark, rows), window) == plain_removal(rows, window)
    assert removal(frame(spark, []), window) == []


@pytest.mark.parametrize("sizes", [{"HOT": 3}, {"PIECE": 97, "BLOCK_BYTES": 500}, {"BUCKET_KEYS": 3, "BUCKET_ROWS": 5, "SHARD": 4}, {"HOT": 0, "BLOCK_BYTES": 1, "BUCKET_ROWS": 20, "SHARD": 3}])
def test_suffix_dedup_at_other_sizes(spark, monkeypatch, sizes):
    """Hot anchors by windows, texts in pieces, many blocks, buckets and shards: the same result."""
    for name, value in sizes.items():
        monkeypatch.setattr(suffix_module, name, value)
    rows = passages(9, 60) + odd_rows()[-6:]
    assert removal(frame(spark, rows).repartition(3), 20) == plain_removal(rows, 20)


def test_suffix_dedup_of_other_ids_and_long_texts(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [("b", long), ("a", long[200_000:900_000]), ("c", "q" + long), (None, "short"), ("d", "short" * 11), (None, "short" * 11)]
    got = {r[0] or r[1]: r for r in removal(spark.createDataFrame(rows, "name string, words string"), 50, id_column="name", text_column="words")}
    assert got["b"][2:4] == (700_000, ((200_000, 900_000),)) and got["a"][2] == 0 and got["c"][2:4] == (1_300_000, ((1, 1_300_001),)) and got["c"][4] == b"q"
    assert got["d"][2] == 0 and got[55][2] == 55 and got[5][2] == 0
    assert got["b"][4] == (long[:200_000] + long[900_000:]).encode()


def test_merged_transforms_give_sorted_suffixes():
    """Of every column: the rows in the order of their suffixes, and the bytes that neighbours share."""
    rng = np.random.default_rng(4)
    window, span = 12, 6
    rows = rng.integers(0, 3, (200, window + span)).astype(np.uint8)
    shards = [rows[a:b] for a, b in ((0, 1), (1, 90), (90, 90), (90, 200))]
    seen = 0
    for j, row, common in merged([transform(s, span) for s in shards], window):
        suffix = [rows[r, span - j :].tobytes() for r in row]
        assert suffix == sorted(r[span - j :].tobytes() for r in rows)
        shared = [next((k for k in range(len(a)) if a[k] != b[k]), len(a)) for a, b in zip(suffix, suffix[1:], strict=False)]
        assert common.tolist() == [0, *shared]
        seen += 1
    assert seen == span + 1
    assert symbols(rows, 0, span)[0] == int(rows[0, -2]) * 256 + int(rows[0, -1])


# --- prefix trie ---


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}".encode()), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:]) if base != c else tuple(turns)
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in members if len(n) == len(node) + 1 and n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, sha(ends.encode())))
    return sorted(out, key=repr)


TRIE = "conv_id bigint, turn bigint, role string, text string, conv bigint, a int, depth string, owner int, key string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "d", 3, "k") for r in rows], TRIE)


def odd_talk():
    rng = random.Random(3)
    say = lambda: rng.choice(["hi", "hello there", "", "ünï 🙂", "a:b", "x" * 50])
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 11, 99, 100, 101, 150, 199, 205, 206, 207, 208, 305, -5, -100, -7, 2**40 + 3]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", say() if t > 1 else "hi"))
    rows += [(3, None, "user", "first"), (3, None, None, None), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "userti", "e"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 460) for t in range(4)]
    rows += [(c, 0, "user", "one") for c in range(310, 320)]  # without conversation 300: some are left without turns
    rows += [(600, t, "u", "long " * (t % 3)) for t in range(300)] + [(601, t, "u", "long " * (t % 3)) for t in range(299)]
    rows += [(700, 0, "u", "é" * 200_000), (701, 0, "u", "é" * 200_000)]
    return rows


def test_prefix_trie_against_a_plain_trie(spark):
    rows = odd_talk()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = prefix_trie(talk(spark, rows))
    assert got.columns == names and {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)
    assert any(r[3] == 1 and r[1] == 0 for r in plain_trie([(1, 0, "u", "x")]))
    assert prefix_trie(talk(spark, [])).count() == 0 and prefix_trie(talk(spark, rows[-7:][:0] + [(None, 1, "u", "x")])).count() == 0


def test_prefix_trie_at_any_partitioning(spark):
    rows = odd_talk()
    want = plain_trie(rows)
    for parts in (1, 13):
        assert sorted((tuple(r) for r in prefix_trie(talk(spark, rows).repartition(parts)).collect()), key=repr) == want


# --- centroids ---


def plain_centroids(rows, k, width, scale, rounds):
    """In Python's integers throughout."""
    kept = [(i, [int(x) * scale if abs(x) >= 2**52 else int(np.floor(x * scale)) for x in v], v) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}".encode()), r[2]))[:k]
    cent = [r[1] for r in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), j) for j, c in enumerate(cent)) for _, e, _ in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cent)):
            own = [e for (_, e, _), (_, x) in zip(kept, at, strict=True) if x == j]
            if own:
                cent[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at, top = assign(), 2**63 - 1
    per = defaultdict(int)
    for d, j in at:
        per[j] += d
    total = min(sum(per.values()), top)
    return sorted([(i, j, min(d, top), min(per[j], top), total, sha(",".join(map(str, cent[j])).encode())) for (i, _, _), (d, j) in zip(kept, at, strict=True)], key=repr)


VECTORS = "vec_id bigint, embedding array<double>, cluster int, ident string, vec int, idents string"


@pytest.mark.parametrize("size", [1.0, 2.0**40, 2.0**300])
def test_centroids_against_python_integers(spark, size):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.standard_normal(4) * size).tolist()) for i in range(120)]
    rows += [(200, [1.0, None, 2.0, 3.0]), (201, None), (202, []), (203, [1.0, 2.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [0.0] * 4), (206, [0.0] * 4), (206, [-0.0, 1e-300, -1e-300, 0.5])]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (None, None), *rows[:7], (300, [0.25] * 4), (301, [0.25] * 4)]
    df = spark.createDataFrame([(*r, 7, "i", 8, "x") for r in rows], VECTORS)
    got = [tuple(r) for r in nearest_centroids(df, k=5, width=4, scale=64, rounds=3).collect()]
    assert sorted(got, key=repr) == plain_centroids(rows, 5, 4, 64, 3)


def test_centroids_small_tables_and_other_ids(spark):
    df = spark.createDataFrame([("a", [0.5, 1.0]), ("b", [0.5, 1.0]), ("c", [-3.0, 2.0])], "name string, v array<float>")
    got = sorted(tuple(r) for r in nearest_centroids(df, "name", "v", k=16, width=2).collect())
    assert got == plain_centroids([("a", [0.5, 1.0]), ("b", [0.5, 1.0]), ("c", [-3.0, 2.0])], 16, 2, 64, 3)
    assert nearest_centroids(df, "name", "v", k=16, width=3).collect() == []
    with pytest.raises(ValueError):
        nearest_centroids(df, "name", "v", scale=3)


def test_product_of_matrices_equals_integers_up_to_its_bound(monkeypatch):
    """Components just below and above the guard: all three ways give what integers give."""
    rng = np.random.default_rng(2)
    for most in (100, 2**23, 2**24, 2**30, 2**31, 2**61):
        x = rng.integers(-most, most + 1, (40, 8))
        c = Centroids([[int(v) for v in row] for row in rng.integers(-most, most + 1, (5, 8))])
        cluster, distance = c.nearest(x)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, m, strict=True)), j) for j, m in enumerate(c.rows)) for row in x]
        assert [(int(d), int(j)) for d, j in zip(distance, cluster, strict=True)] == want
    assert quantise(np.array([1.0, -1.5]), 2, 64).dtype == np.int8 and quantise(np.array([2.0, -2.0]), 2, 64).dtype == np.int16
    big = quantise(np.array([2.0**80, -0.3]), 2, 64)
    assert big.tolist() == [[2**86, -20]] and unpack(pack(big), 2).tolist() == big.tolist()
    monkeypatch.setattr(centroids_module, "EXACT", 1)  # integers alone give the same
    c = Centroids([[1, 2], [3, 4]])
    assert c.nearest(np.array([[1, 2], [9, 9], [2, 3]]))[1].tolist() == [0, 61, 2]
    assert c.totals(np.array([[1, 2], [9, 9], [2, 3]])) == {0: (2, 2, [3, 5]), 1: (1, 61, [9, 9])}
