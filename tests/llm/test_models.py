from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lensaudit.llm import bpe, brown_lm, registry
from lensaudit.llm.bpe import Bpe, decode, encode
from lensaudit.llm.brown_lm import brown_scores, exchange_classes
from lensaudit.llm.common import bucket_of
from lensaudit.llm.language_id import fit_languages, keep_known, predict_languages
from lensaudit.llm import mixing
from lensaudit.llm.mixing import mix_counts, mix_documents, repeating, water_fill
from lensaudit.llm.quality_rules import STATISTICS, RuleModel, fit_quality, measure, score_quality, train_rules
from lensaudit.llm.toxicity import fit_toxicity, score_toxicity, train_pu

from .helpers import WORDS, frame, odd_rows

lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
part = lambda i, n: zlib.crc32(("" if i is None else str(i)).encode()) % n


# --- mixing ---


@pytest.mark.parametrize("sizes", [[], [10], [100, 1, 1, 1], [5, 0, 7], [10**9, 3, 10**6, 8, 8, 8], [0, 0]])
def test_water_fill(sizes):
    weights = repeating(len(sizes))
    got = water_fill(sizes, weights, 3)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(0 <= t <= 3 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    free = [t / w for t, w, s in zip(got, weights, sizes, strict=True) if t < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def test_mix_counts_and_documents(spark):
    docs = frame(spark, odd_rows() + [(90, "seven words make all sources differ here", "en", None)] + [(i, "w " * (i % 7 + 1), "en", f"t{i % 3}") for i in range(100, 400)])
    got = mix_counts(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_counts(docs.repartition(7)).collect()), key=repr)
    assert len(got) == docs.count()
    by_source, whole = {}, Counter()
    for r in got:
        whole[r["source_size"], r["doc_id"]] += r["size"]
    for r in got:
        s = by_source.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["taken"]
        s[1] = max(s[1], whole[r["source_size"], r["doc_id"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for (size, target), (taken, largest) in by_source.items():
        assert abs(taken - target) <= largest / 2 + 1e-6 or target == 0, (size, target, taken)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORDS.findall(r["text"] or "")) for r in mixed.collect())
    assert words == sum(r["taken"] for r in got)
    assert mix_counts(frame(spark, [])).count() == 0 and mix_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("epochs", [0.5, 1, 3])
@pytest.mark.parametrize("sizes", [[], [10], [100, 1, 1, 1], [5, 0, 7], [10**9, 3, 10**6, 8, 8, 8], [0, 0], [7] * 50, list(range(1, 90))])
def test_filled_table_against_filled_list(spark, sizes, epochs):
    named = [(i == len(sizes) - 1, "" if i == len(sizes) - 1 else f"s{i:03d}", n) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(named, "_none boolean, _source string, source_size bigint").repartition(5)
    got = [r["target"] for r in mixing.fill(table, epochs, mixing.by_threes).orderBy("_none", "_source").collect()]
    assert got == pytest.approx(water_fill(sizes, repeating(len(sizes)), epochs), rel=1e-12)


def test_weights_of_nothing_take_nothing(spark):
    table = spark.createDataFrame([(False, s, 10) for s in "abcd"], "_none boolean, _source string, source_size bigint")
    weigh = lambda place: F.when(place == 1, 0.0).otherwise(1.0)
    assert [r["target"] for r in mixing.fill(table, 3, weigh).orderBy("_source").collect()] == pytest.approx([40 / 3, 0, 40 / 3, 40 / 3])
    assert [r["target"] for r in mixing.fill(table, 3, lambda place: place * 0.0).collect()] == [0.0] * 4


def test_mixing_of_many_sources(spark, monkeypatch):
    """Salted joins and sums over several ranges of sources give what broadcasts and one range do; one source has a third of all rows."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 1500)).alias("source"))
    want = sorted(map(tuple, mix_counts(docs).collect()))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        assert sorted(map(tuple, mix_counts(docs).collect())) == want
        assert mix_documents(docs).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    rows = {i: (n, taken, target) for i, n, _, target, taken in want}
    assert sum(n for n, *_ in rows.values()) == pytest.approx(sum(r[4] for r in want), rel=0.2) and len(rows) == 6000


# --- language model ---


def test_brown_scores_base_is_the_unigram_model(spark):
    rows = odd_rows()
    tokens = [[*(w.translate(lower) for w in WORDS.findall(r[1] or "")), None] for r in rows]
    held = [part(r[0], 5) == 1 for r in rows]
    counts = Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    expected = [(r[0], h, len(t), sum(counts[x] > 0 for x in t), total, sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in t)) for r, t, h in zip(rows, tokens, held, strict=True)]
    got = [tuple(r) for r in brown_scores(frame(spark, rows), bucket_of("doc_id", 5) == 1).collect()]
    key = lambda r: (repr(r[0]), *r[1:5], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] < 0 and math.isfinite(a[6])
    assert brown_scores(frame(spark, []), F.lit(False)).count() == 0
    assert all(r["n_known"] == 0 for r in brown_scores(frame(spark, rows[:2]), F.lit(True)).collect())


def test_brown_beats_the_unigram_model_on_held_out_text(spark, sf_dir):
    held = registry.op2_brown_lm(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert held[2] > 20 and held[0] > held[1]


def test_brown_places_rare_words_by_their_own_contexts(spark):
    """Words of one ending, far beyond the most frequent, that follow different words: the shape alone can't tell them apart."""
    common = " ".join(f"w{i}" for i in range(900))
    left, right = [f"l{i}zz" for i in range(30)], [f"r{i}zz" for i in range(30)]
    rows = [(i, common, "", "") for i in range(5)] + [(10 + i, f"w1 a{i % 10} w2", "", "") for i in range(200)] + [(10 + i, f"w3 b{i % 10} w4", "", "") for i in range(200)]
    rows += [(210 + i, f"w1 {x} w2", "", "") for i, x in enumerate(left)] + [(250 + i, f"w3 {x} w4", "", "") for i, x in enumerate(right)]
    rows += [(300, "w1 l1zz w2", "", ""), (301, "w1 r1zz w2", "", ""), (302, "w3 r1zz w4", "", ""), (303, "w3 l1zz w4", "", "")]
    got = {r["doc_id"]: r for r in brown_scores(frame(spark, rows), F.col("doc_id") >= 300).collect()}
    assert all(got[i]["n_known"] == 4 for i in range(300, 304))
    assert got[300]["score"] > got[301]["score"] + 0.3 and got[302]["score"] > got[303]["score"] + 0.3


def test_brown_assigns_as_one_exchange_would(monkeypatch):
    """Gains of a word's classes against the likelihood counted anew with the word in each class."""
    monkeypatch.setattr(brown_lm, "CLASSES", 4)
    rng = np.random.default_rng(3)
    between = rng.integers(30, 90, (4, 4))
    context, n = np.array([5, 6, 11, 3, 14]), np.array([2, 20, 1, 3, 30])  # of shape 0, in class 2
    put = np.zeros((2, 4))
    np.add.at(put[0], context // 4, n)
    np.add.at(put[1], context % 4, n)
    between[:, 2] += put[0].astype(int)
    between[2] += put[1].astype(int)
    x = lambda a: float((a * np.log(np.maximum(a, 1))).sum())
    worth = []
    for c in range(4):
        before, after = between.T.astype(float), between.astype(float)
        for a, p in ((before, put[0]), (after, put[1])):
            a[2] -= p
            a[c] += p
        worth.append(sum(x(a) - x(a.sum(1)) for a in (before, after)))
    shape, total, cls = brown_lm.Assigner(between, np.array([2])).assign(np.zeros(5, int), context, n)
    assert (shape[0], total[0], cls[0]) == (0, 56, int(np.argmax(worth)))


def test_exchange_finds_words_that_behave_alike():
    counts = np.zeros((8, 8))
    counts[:4, 4:] = counts[4:, :4] = 10
    label = exchange_classes(counts, 2)
    assert len(set(label[:4])) == len(set(label[4:])) == 1 and label[0] != label[4]


# --- encoding ---


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoding_is_the_librarys(spark):
    path, lib, rows = registry.byte_vocabulary(), library(), odd_rows()
    rows += [(50, "x" * 3000, "", ""), (51, "<|endoftext|><|endoftext|> a\u0085b\x1c\x1d   \n\n c", "", "")]
    out = encode(frame(spark, rows), path)
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in out.collect()) == want
    assert Counter(r["text"] for r in decode(out, path).collect()) == Counter(r[1] or "" for r in rows)
    assert encode(frame(spark, []), path).count() == 0


def test_encoding_of_random_strings():
    import random

    with open(registry.byte_vocabulary(), "rb") as f:
        bpe = Bpe(f.read())
    lib, rng = library(), random.Random(8)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "23", "'s", "'ll", "<|endoftext|>", "<|endof", "日本", "🙂", "\x1c", "\u0085", "the", "ing", "!!!", "aaaa", "́", "​", "²"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids) == text


# --- classifiers ---


def test_language_of_held_out_documents(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents")
    got = registry.op8_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_documents(spark):
    docs = frame(spark, odd_rows())
    model = fit_languages(docs, F.lit(True))
    got = predict_languages(docs, model, F.col("doc_id")).collect()
    assert len(got) == docs.count()
    und = Counter(r["carried"] for r in got if r["lang_pred"] == "und")
    assert und == Counter([6, 7, 8, 11, None, None])
    kept = keep_known(docs, F.lit(True))
    assert kept.columns == docs.columns and not {6, 7, 8, 11} & {r["doc_id"] for r in kept.collect()}
    nothing = predict_languages(docs, fit_languages(docs, F.lit(False)), F.col("doc_id")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert predict_languages(frame(spark, []), model, F.col("doc_id")).count() == 0


def labelled(spark, rows):
    return spark.createDataFrame([(r[0], i % 2, i % 2, "x") for i, r in enumerate(rows)] + [(None, 1, 0, ""), (1, None, None, ""), (2, 1, 1, "")], "doc_id bigint, quality int, toxic int, text string")


@pytest.mark.parametrize("fit, score", [(fit_quality, score_quality), (fit_toxicity, score_toxicity)])
def test_scores_of_odd_documents(spark, fit, score):
    docs = frame(spark, odd_rows())
    labels = labelled(spark, odd_rows())
    for model in (fit(docs, labels, F.lit(True)), fit(docs, labels, F.lit(False))):
        got = score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score(frame(spark, []), model).count() == 0


def area(pairs):
    """Chance that a document of label 1 scores above one of label 0."""
    one, zero = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero))


@pytest.mark.parametrize("query, label, least", [("op6_quality_rules", "quality", 0.95), ("op9_toxicity_pu", "toxic", 0.9)])
def test_held_out_labels(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()[query](spark, sf).where("held_out").join(registry.table(spark, sf, "labels").select("doc_id", label), "doc_id").collect()
    assert area([(r["score"], r[label]) for r in got]) >= least


def test_rules_as_columns_give_the_numpy_score(spark):
    docs = frame(spark, odd_rows())
    x = np.random.default_rng(0).random((300, len(STATISTICS)))
    model = train_rules(x, (x[:, 2] > 0.4).astype(float))
    assert model.rules
    stats = measure(docs.select(F.col("doc_id").alias("ident"), F.coalesce("text", F.lit("")).alias("text")))
    for r in stats.withColumn("score", model.column()).collect():
        own = np.array([r[s] for s in STATISTICS])
        total = model.bias + sum(w for rule, w in model.rules if all((own[j] > cut) == above for j, above, cut in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))
    assert RuleModel([], 0.0).column() is not None


def test_pu_learning_ignores_positives_among_the_unlabelled():
    rng = np.random.default_rng(1)
    doc = lambda toxic: np.unique(np.append(rng.integers(10, 400, 30), [3] if toxic else []).astype(int))
    model = train_pu([doc(True) for _ in range(200)], [doc(i % 5 == 0) for i in range(600)], 0.2)
    s = lambda d: model.score(np.zeros(len(d), int), d, 1)[0]
    assert sum(s(doc(True)) > 0.5 for _ in range(100)) >= 95 and sum(s(doc(False)) < 0.5 for _ in range(100)) >= 95


# --- digests ---


def test_queries_give_digests(spark, sf_dir):
    got = {r["doc_id"]: r for r in registry.op5_bpe(spark, sf_dir).collect()}
    for r in registry.table(spark, sf_dir, "documents").limit(20).collect():
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_encoders_give_small_batches():
    class Vocabulary:
        value = open(registry.byte_vocabulary(), "rb").read()

    texts = [None, "", *(f"word{i} wörter{i} " * 200 for i in range(400))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([x or "" for x in texts])], ["ident", "text"])
    out = list(bpe._encoded(Vocabulary)(iter([batch])))
    assert sum(x.num_rows for x in out) == len(texts) and max(x.nbytes for x in out) < 2 << 20
    assert [x.as_py() for b in out for x in b.column(2)] == [x or "" for x in texts]


def test_automaton_reads_each_piece_once_and_finds_all_tokens():
    """States, suffix links and dictionary links against all tokens that end a prefix."""
    import random

    with open(registry.byte_vocabulary(), "rb") as f:
        bpe = Bpe(f.read())
    rng, tokens = random.Random(3), {bpe.bytes[i]: i for i in bpe._token if i >= 0}
    assert len(tokens) > 40_000 and len(bpe._suffix) == len(bpe._depth) == 1 + len(bpe._steps)
    for _ in range(200):
        data = b"".join(rng.choice([b" the", b"ing", b"abab", "é".encode(), b"zq", b"  ", b"tion", b"0"]) for _ in range(5))
        state = 0
        for end in range(1, len(data) + 1):
            while (after := bpe._steps.get(state << 8 | data[end - 1])) is None and state:
                state = bpe._suffix[state]
            state = after or 0
            match, found = (state if bpe._token[state] >= 0 else bpe._shorter[state]), []
            while match:
                found.append(bpe._token[match])
                match = bpe._shorter[match]
            assert found == [tokens[data[i:end]] for i in range(end) if data[i:end] in tokens]


# --- the models against plain versions ---


def plain_features(text):
    """Hashed 1- to 3-byte sequences as the docstrings say, byte by byte."""
    from lensaudit.llm import language_id as module

    data, x = (text or "").encode(), []
    for i, byte in enumerate(data):
        seen = int(module._SEEN[byte])
        x.append(seen + 32 if i and data[i - 1] == 0xC3 and 0x80 <= byte <= 0x9E else seen)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(x) - n + 1):
            step = 0
            for v in x[i : i + n]:
                step = (step * 263 + v) % 2**32
            if any(v != 32 for v in x[i : i + n]):
                out[((step * 2654435761 + n * 40503) % 2**32) >> 19] += 1
    out.pop(0, None)
    return out


def test_languages_against_a_plain_version(spark):
    rows = odd_rows() + [(200 + i, f"{t} {i} É", lang, "s") for i in range(12) for lang, t in (("en", "the cat and the dog went"), ("de", "der Hund und die Katze waren"))]
    docs = frame(spark, rows)
    model = fit_languages(docs, F.lit(True))
    taught = [plain_features(r[1]) for r in rows if r[2] is not None and r[1] and any(c.isalpha() for c in r[1])]
    for f in {f for x in taught for f in x}:
        n = sum(f in x for x in taught)
        assert model.idf[f] == pytest.approx(math.log((len(taught) + 1) / (n + 1)) + 0.05, rel=1e-5)
    assert (model.idf > 0).sum() == len({f for x in taught for f in x}) and set(model.languages) == {"en", "fr", "de"}
    assert Counter(model.owner.tolist()) == {0: 4, 1: 4, 2: 3} or max(Counter(model.owner.tolist()).values()) <= 4
    got = Counter()
    for r in predict_languages(docs, model, F.struct("doc_id", "text")).collect():
        counts = plain_features(r["carried"]["text"])
        x = np.zeros(len(model.idf))
        for f, n in counts.items():
            x[f] = n * math.sqrt(model.idf[f])
        likes = model.centroids @ (x / max(np.linalg.norm(x), 1e-12))
        if r["lang_pred"] != "und":
            best = int(np.argmax(likes))
            assert r["score"] == pytest.approx(min(max(likes[best], 0), 1), abs=1e-5)
            assert likes[[i for i, o in enumerate(model.owner) if model.languages[o] == r["lang_pred"]]].max() == pytest.approx(likes[best], abs=1e-6)
            assert r["rejected"] == (r["score"] < model.least[model.languages.index(r["lang_pred"])])
        got[r["lang_pred"] == "und", not (r["carried"]["text"] and any(c.isalpha() for c in r["carried"]["text"]))] += 1
    assert set(got) == {(True, True), (False, False)}


def test_every_language_is_learned_however_many(spark, monkeypatch):
    from lensaudit.llm import language_id as module

    monkeypatch.setattr(module, "SAMPLE_ALL", 20)
    docs = frame(spark, [(i, f"word{i} text{i}", f"l{i % 60}", "") for i in range(600)])
    assert len(fit_languages(docs, F.lit(True)).languages) == 60


def test_first_split_against_all_splits():
    from lensaudit.llm.quality_rules import grow

    rng = np.random.default_rng(4)
    x, residual = np.round(rng.random((60, 3)), 1), rng.normal(size=60)
    residual[x[:, 1] > 0.6] += 1
    cuts = [np.unique(x[:, j]) for j in range(3)]
    best = max(
        (sum(residual[s].sum() ** 2 / s.sum() for s in (x[:, j] <= c, x[:, j] > c)), -j, -c) for j in range(3) for c in cuts[j] if 5 <= (x[:, j] <= c).sum() <= 55
    )
    rules = grow(x, residual, cuts, 1)
    assert [(r[0][0], r[0][1], r[0][2]) for r, _ in rules] == [(-best[1], side, -best[2]) for side in (False, True)]
    for rule, value in rules:
        (j, above, cut), = rule
        assert value == pytest.approx(residual[(x[:, j] > cut) == above].mean())


def test_lasso_meets_its_conditions():
    """At the least value, slopes of weights that are 0 are within the penalty, and all others meet it."""
    from lensaudit.llm.quality_rules import lasso_logistic

    rng = np.random.default_rng(5)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1] + 0.5)))).astype(float)
    w, b = lasso_logistic(r, y, 0.02, steps=5000)
    p = 1 / (1 + np.exp(-(r @ w + b)))
    slope = r.T @ (p - y) / 400
    assert abs((p - y).mean()) < 1e-4 and 0 < (w == 0).sum() < 12
    assert np.all(np.abs(slope[w == 0]) <= 0.02 + 1e-4) and np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)


def test_pu_steps_against_a_plain_version():
    """The same descent written out document by document, with the risk's slopes taken by differences."""
    rng = np.random.default_rng(2)
    positive = [np.unique(np.append(rng.integers(0, 6, 2), 7)) for _ in range(20)]
    unlabelled = [np.unique(np.append(rng.integers(0, 6, 3), 7 if i % 4 == 0 else 6)) for i in range(40)]
    prior, steps = 0.25, 3
    model = train_pu(positive, unlabelled, prior, steps=steps, penalty=0.0)
    chosen = np.flatnonzero(model.weights)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    score = lambda v, d: sigmoid(v[-1] + sum(v[k] for k, f in enumerate(chosen) if f in d))

    def parts(v):
        plus = np.mean([-math.log(score(v, d)) for d in positive])
        minus = np.mean([-math.log(1 - score(v, d)) for d in unlabelled]) - prior * np.mean([-math.log(1 - score(v, d)) for d in positive])
        return prior * plus, minus

    v, m, s = np.append(np.zeros(len(chosen)), math.log(prior / (1 - prior))), 0.0, 0.0
    for t in range(1, steps + 1):
        worth = (lambda u: sum(parts(u))) if parts(v)[1] >= 0 else (lambda u: -parts(u)[1])
        slope = np.array([(worth(v + e) - worth(v - e)) / 2e-6 for e in 1e-6 * np.eye(len(v))])
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope * slope
        v = v - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    assert 7 in chosen and np.allclose(model.weights[chosen], v[:-1], atol=1e-4) and model.bias == pytest.approx(v[-1], abs=1e-4)


def test_pu_holds_a_bounded_number_of_features(spark, monkeypatch):
    from lensaudit.llm import toxicity as module

    docs = frame(spark, [(i, " ".join("".join(chr(97 + (i * 50 + j) // 26**k % 26) for k in range(3)) for j in range(50)), "", "") for i in range(200)])
    monkeypatch.setattr(module, "HELD", 3000)
    held = module._gathered(docs.select("text"))
    assert 1000 < sum(map(len, held)) < 6000


def test_class_model_is_a_probability():
    """For each class: transitions add up to 1, and so do the emissions of its words and of one unknown word a shape."""
    rng = np.random.default_rng(1)
    n = brown_lm.CLASSES
    between = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.3)
    between[5] = 0
    tokens = between.sum(0)
    known = [rng.multinomial(t - min(t, 3), np.ones(min(t, 3)) / max(min(t, 3), 1)) + 1 if t else np.zeros(0, int) for t in tokens]
    unknown = rng.integers(1, 5, n)
    moves, mass = brown_lm._model(between, np.array([len(k) for k in known]) + unknown)
    assert np.allclose((10**moves).sum(1), 1)
    for c in range(n):
        assert ((known[c] + 0.5).sum() + 0.5 * unknown[c]) / 10 ** mass[c] == pytest.approx(1)


LONG = 400_000


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of some MB beside short ones; half of it comes a second time."""
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(5000)])[rng.integers(0, 5000, LONG)]
    text = " ".join(words)
    return frame(spark, [(1, text, "en", "a"), (2, text.replace(" ", "\n", 9), "en", "b"), (3, " ".join(words[: LONG // 2]), "en", "a"), (4, "short text of a few words", "de", "b"), (5, None, None, None)])


@pytest.mark.parametrize("name", ["mix", "brown", "exact", "bpe", "quality", "substring", "language", "toxicity", "near"])
def test_texts_of_some_megabytes(spark, long_docs, name):
    from lensaudit.llm.exact_dedup import exact_dedup
    from lensaudit.llm.minhash_dedup import near_duplicates
    from lensaudit.llm.substring_dedup import substring_dedup

    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], "doc_id bigint, quality int, toxic int")
    model = {"quality": fit_quality, "toxicity": fit_toxicity}
    run = {
        "mix": lambda d: mix_counts(d), "brown": lambda d: brown_scores(d, F.lit(False)), "exact": exact_dedup, "bpe": lambda d: encode(d, registry.byte_vocabulary()), "substring": substring_dedup, "near": near_duplicates,
        "quality": lambda d: score_quality(d, model["quality"](d, labels, F.lit(True))), "toxicity": lambda d: score_toxicity(d, model["toxicity"](d, labels, F.lit(True))),
        "language": lambda d: predict_languages(d, fit_languages(d, F.lit(True)), F.col("doc_id")).withColumnRenamed("carried", "doc_id"),
    }
    got = {r["doc_id"]: r for r in run[name](long_docs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert name != "mix" or got[1]["size"] == LONG
    assert name != "brown" or got[1]["n_tokens"] == got[1]["n_known"] == LONG + 1
    assert name != "exact" or (got[2]["keep_id"], got[3]["keep_id"]) == (1, 3)
    assert name != "substring" or (got[1]["n_removed"], got[3]["n_removed"], got[4]["n_removed"]) == (LONG, LONG // 2, 0)
    assert name != "near" or (got[2]["component_id"], got[3]["component_id"], got[1]["n_shingles"]) == (1, 3, LONG - 4)
    assert name != "bpe" or got[1]["decoded"].count(" ") == LONG - 1


def test_brown_clusters_words_however_rare(spark, monkeypatch):
    """All words of one count, more than are broadcast: some of them are exchanged all the same, and counts stay right."""
    monkeypatch.setattr(brown_lm, "KNOWN", 100)
    rows = [(i, " ".join(f"v{i}x{j}" for j in range(40)), "", "") for i in range(30)]
    got = brown_scores(frame(spark, rows), F.lit(False)).collect()
    total, distinct = 30 * 41, 30 * 40 + 1
    base = 40 * math.log10(1.5 / (total + 0.5 * (distinct + 1))) + math.log10(30.5 / (total + 0.5 * (distinct + 1)))
    assert all(r["n_known"] == 41 and r["base_score"] == pytest.approx(base) and math.isfinite(r["score"]) for r in got)
