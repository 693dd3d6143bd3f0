"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, bucket_of

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(table(spark, sf_dir, "documents"), epochs=3, seed=7)


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown_lm import brown_scores

    return brown_scores(table(spark, sf_dir, "documents"), bucket_of("doc_id", 5) == 1)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    out = encode(table(spark, sf_dir, "documents"), byte_vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit_quality, score_quality

    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) == 0
    scored = score_quality(docs, fit_quality(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_languages, predict_languages

    docs, held_out = table(spark, sf_dir, "documents"), bucket_of("doc_id", 3) == 1
    found = predict_languages(docs, fit_languages(docs, ~held_out), F.col("doc_id"))
    return found.select(F.col("carried").alias("doc_id"), "lang_pred", "score", "rejected").withColumn("held_out", held_out)


def op9_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) == 0
    scored = score_toxicity(docs, fit_toxicity(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), group=100, heads=6)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import nearest_centroids

    return nearest_centroids(table(spark, sf_dir, "embeddings"), k=16, width=64, scale=64, rounds=3)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()} | {"pipeline": pipeline}


_SPACES = r"[\x20\x09-\x0D]+"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": r"""
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                       ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT AS draw FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
            w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM s),
            c AS (SELECT *, row_number() OVER o AS k, 3.0::DOUBLE * source_size / weight AS ratio, coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS clamped,
                  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)),
            l AS (SELECT arg_min((total - clamped) / rest, k) AS level FROM c WHERE (total - clamped) / rest <= ratio),
            t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target FROM c, l),
            p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, doc_id) AS ends, sum(d.size) OVER (PARTITION BY d.source, draw, doc_id) AS together
                  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
            SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN 2 * ends - together < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p""",
        "op3_exact_dedup": rf"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256)""",
        "op4_embedding_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
            link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
            reach(u, v) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v),
            n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
            SELECT v.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(reach.v) AS component_id, v.vec_id = min(reach.v) AS kept
            FROM v JOIN reach ON reach.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id GROUP BY v.vec_id""",
        "op7_substring_dedup": rf"""
            WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '') AS words FROM documents),
            s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w),
            h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS win FROM s),
            r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY win) > 1),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
            word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
            agg AS (SELECT doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS kept
                    FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
            SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM w LEFT JOIN agg USING (doc_id)""",
        "op10_minhash_dedup": rf"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda x: x <> '') AS words FROM documents),
            s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 3], ' ')) AS shingle
                  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
            link AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
            reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v)
            SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.v) AS component_id, d.doc_id = min(reach.v) AS kept
            FROM documents d JOIN reach ON reach.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
        "op11_suffix_dedup": """
            WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
            s AS (SELECT doc_id, b, unnest(range(1, octet_length(b)::BIGINT - 48)) AS i FROM d),
            h AS (SELECT doc_id, i, md5(b[i:i + 49]) AS win FROM s),
            r AS (SELECT doc_id, i FROM h QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
            g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM r)),
            gone AS (SELECT doc_id, min(i) AS begins, max(i) + 49 AS ends FROM g GROUP BY doc_id, span),
            kept AS (SELECT doc_id, b, coalesce(lag(ends) OVER w, 0) + 1 AS lo, begins - 1 AS hi, ends FROM gone JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY begins)),
            part AS (SELECT doc_id, lo, hex(b[lo:hi]) AS x FROM kept WHERE lo <= hi UNION ALL SELECT doc_id, max(ends) + 1, hex(any_value(b)[max(ends) + 1:octet_length(any_value(b))]) FROM kept GROUP BY doc_id),
            text AS (SELECT doc_id, string_agg(x, '' ORDER BY lo) AS x FROM part GROUP BY doc_id),
            n AS (SELECT doc_id, sum(ends - begins + 1) AS removed, count(*) AS spans FROM gone GROUP BY doc_id)
            SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
                   CASE WHEN x IS NULL THEN sha256(b) ELSE sha256(unhex(x)) END AS kept_sha256
            FROM d LEFT JOIN n USING (doc_id) LEFT JOIN text USING (doc_id)""",
        "op12_prefix_trie": """
            WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
            ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
            head AS (SELECT c, c - c % 100 AS base, CASE WHEN c % 100 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 6 END AS h FROM ids, tab),
            turns AS (SELECT conv_id, len(coalesce(text, ''))::BIGINT AS tokens, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place FROM conversations),
            rebuilt AS (SELECT c, 0 AS own, place, tokens, digest FROM head JOIN turns ON conv_id = base AND place <= h UNION ALL SELECT c, 1, place, tokens, digest FROM head JOIN turns ON conv_id = c AND place > h),
            path AS (SELECT c, row_number() OVER w AS depth, tokens, sha256(string_agg(digest, ',') OVER w) AS node FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, place ROWS UNBOUNDED PRECEDING)
                     UNION ALL SELECT c, 0, 0, '' FROM ids),
            step AS (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ends FROM path WINDOW w AS (PARTITION BY c ORDER BY depth)),
            node AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n, any_value(tokens) AS tokens, bool_and(ends) AS leaf,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM step GROUP BY node),
            below AS (SELECT DISTINCT a.node AS top, b.node FROM step a JOIN step b ON a.c = b.c AND a.depth <= b.depth),
            sums AS (SELECT top, sum((n - 1) * tokens) AS saved, count(*) FILTER (leaf) AS leaves FROM below JOIN node USING (node) GROUP BY top),
            kids AS (SELECT parent, count(*) AS n FROM node GROUP BY parent)
            SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
            FROM node x JOIN sums ON top = x.node LEFT JOIN node p ON p.node = x.parent LEFT JOIN kids ON kids.parent = x.node""",
        "op13_centroid_clustering": _centroid_sql(),
    }


def _centroid_sql() -> str:
    """Three rounds of assignment and update, one after the other, and a last assignment."""
    sql = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, e AS m FROM v QUALIFY k < 16)"""
    for r in range(4):
        sql += f""",
            d{r} AS MATERIALIZED (SELECT vec_id, e, k, list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) * (e[i] - m[i])))::BIGINT AS d FROM v, c{r}),
            a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        if r < 3:
            sql += f""",
            s{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY k, i),
            c{r + 1} AS MATERIALIZED (SELECT k, coalesce(any_value(f), any_value(m)) AS m FROM c{r} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS f FROM s{r} GROUP BY k) USING (k) GROUP BY k)"""
    return f"""{sql}
            SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (k)"""
