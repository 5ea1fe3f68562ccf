"""A corpus from raw documents to token shards, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents, whatever further columns they have.
In every stage empty tables give an empty result, and repeated rows and null ids are defined as
in the operator it calls; each docstring says what becomes of null and empty texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, language_id, mixing, simhash, token_shards
from tidewright.llm.common import stored

#: No SQL expresses the stages.
ORACLE_SQL = None
#: Documents whose leading language holds less than this share are no language's text.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those in which no language leads; learns from the labels in docs.

    Without any label every document is unknown and goes.
    """
    row = F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row")
    found = language_id.identify(docs, language_id.train(docs), keep=(row,))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group linked by a Jaccard similarity of 0.8 of five-word shingles.

    Texts without a word are one group. Of repeated rows of an id that stays, one stays.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources near their targets: a row for each copy.

    Longer texts have better odds. Null and empty texts have size 0 and are taken by rank alone.
    """
    taken = mixing.mix(docs, weight=mixing.root_of_size(F.col("text")))
    return taken.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards and returns what they hold: doc_id, start, n_tokens, ids_crc32; null and empty texts hold the end id alone."""
    manifest = token_shards.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_shards.digest(token_shards.read_shards(manifest))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
