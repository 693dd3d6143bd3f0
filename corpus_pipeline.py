"""From raw documents to encoded training text: language ID, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each bounds the session's Arrow batches,
as its result may be computed by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language learned from two thirds of docs, go."""
    from lensaudit.llm.common import bound_batches, bucket_of
    from lensaudit.llm.language_id import keep_known

    bound_batches(spark)
    return keep_known(docs, bucket_of("doc_id", 3) != 1)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the least doc_id stays."""
    from lensaudit.llm.common import bound_batches
    from lensaudit.llm.exact_dedup import drop_copies

    bound_batches(spark)
    return drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of shared five-word shingles, directly or by others, the one with the least doc_id stays."""
    from lensaudit.llm.common import bound_batches
    from lensaudit.llm.minhash_dedup import drop_near_copies

    bound_batches(spark)
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by code point weigh 1, 2, 3, repeating; no document comes more than 3 times. A document taken n times is n rows."""
    from lensaudit.llm.common import bound_batches
    from lensaudit.llm.mixing import mix_documents

    bound_batches(spark)
    return mix_documents(docs, epochs=3, seed=7)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of the ids and of the text they give."""
    from lensaudit.llm.bpe import encode
    from lensaudit.llm.common import bound_batches
    from lensaudit.llm.registry import byte_vocabulary

    bound_batches(spark)
    out = encode(docs, byte_vocabulary())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_duplicates),
    ("mix_sources", mix),
    ("bpe", encode_text),
]

#: Language ID, the draw of the mix and the encoding are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lensaudit.llm.common import materialize, operator

    def stages(docs: DataFrame) -> DataFrame:
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = materialize(docs)
        return docs

    return operator(stages)(spark.read.parquet(f"{sf_dir}/documents.parquet"))
