"""From raw documents to token ids: quality rules, near-duplicate removal, redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import minhash, mixing, pieces, pii, quality_rules
from loanloom.llm.common import documents
from loanloom.session import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the boosted trees keep.  Null and empty texts have too few words and go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules.filtered(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8."""
    return minhash.deduplicated(docs, width=5, numerator=8, denominator=10)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; ``n_chars`` follows the new text."""
    masked = pii.redacted(docs)
    counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", counted).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, twice or three times."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of each row."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encoded(docs.select("doc_id", "text", "lang", "source"), model)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_copies),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The trees, the draws of the mix and the tokenizer are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, stage results stored in the shared folder of ``spark.checkpoint.dir``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
