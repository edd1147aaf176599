"""From raw documents to a mixed, encoded corpus, in five stages.

Each stage works on all that its predecessor kept. All but the last return the
columns of ``documents``; n_chars is brought up to date where a text changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creativeaudit.llm import lines, minhash, mixing, pieces, quality
from creativeaudit.llm.common import stored, table
from creativeaudit.llm.queries import trusted_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = "piece_bpe_32k.model"


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents whose perplexity is above their language's threshold go."""
    return quality.keep_good(docs, trusted_ids(spark, sf_dir)).select(COLUMNS)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: later copies of line runs go, and with them documents of which nothing else was left."""
    out = lines.drop_repeated_lines(docs)
    changed = F.col("n_lines_removed") > 0
    out = out.filter(~changed | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each component of near-duplicates (five words, 0.8) the document with the smallest id stays."""
    gone = minhash.near_duplicates(docs, percent=80).filter("NOT kept").select("doc_id").distinct()
    return minhash.without(docs, gone).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sources meet their target weights; a document that is taken twice is there twice."""
    out = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return out.filter("copies > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the ids of every text, and the digest of what they decode to."""
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(MODEL), keep_text=False, digest="decoded_sha256")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("quality classifier", good_text), ("line dedup", new_lines), ("near-duplicates", one_of_each),
          ("source mix", mixed_sources), ("sentencepiece", encoded)]
#: SQL can express neither the language model nor the merges; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"stage-{n + 1}-{name.replace(' ', '-')}")
    return docs
