from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lensaudit.llm import registry
from lensaudit.llm.common import bucket_of
from lensaudit.llm.language_id import fit_languages, predict_languages
from lensaudit.llm.mixing import repeating, water_fill

from .helpers import WORDS, frame, odd_rows
from .test_dedup import norm, plain_groups
from .test_models import library


def draw(i):
    return int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16)


def plain_mix(rows):
    """Rows (doc_id, text, source) to how often each is taken."""
    size = {r[0]: len(WORDS.findall(r[1])) for r in rows}
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r[0])
    sources = sorted((s for s in groups if s is not None)) + ([None] if None in groups else [])
    totals = [sum(size[i] for i in groups[s]) for s in sources]
    out = {}
    for s, total, target in zip(sources, totals, water_fill(totals, repeating(len(sources)), 3), strict=True):
        whole = int(target // total) if total else 0
        so_far = 0
        for i in sorted(groups[s], key=lambda i: (draw(i), i)):
            more = 2 * so_far + size[i] < 2 * (target - whole * total)
            so_far += size[i]
            out[i] = whole + more
    return out


def test_run_against_a_plain_version(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents")
    learn = bucket_of("doc_id", 3) != 1
    known = {r["carried"] for r in predict_languages(docs, fit_languages(docs, learn), F.col("doc_id")).where("NOT rejected").collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if r["doc_id"] in known]
    first = {}
    for r in rows:
        first.setdefault(norm(r["text"]), r)
    rows = [r for r in rows if first[norm(r["text"])] is r]
    kept = {i for (i, n, _, own) in plain_groups([(r["doc_id"], r["text"]) for r in rows], 5) if own or not n}
    rows = [r for r in rows if r["doc_id"] in kept]
    times, lib, want = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in rows]), library(), Counter()
    for r in rows:
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += times[r["doc_id"]]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == +want and len(want) > 50


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_documents(spark, sf_dir, name, stage):
    for rows in (odd_rows(), []):
        docs = frame(spark, rows)
        out = stage(spark, docs, sf_dir)
        assert name == "bpe" or out.columns == docs.columns
        assert out.count() <= 3 * len(rows)


def test_query_is_registered():
    assert "pipeline" in registry.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "mix_sources", "bpe"]
