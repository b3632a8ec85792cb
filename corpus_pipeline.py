"""From raw documents to packed training sequences: quality rules, near-duplicates, repeated passages, packing.

Each stage's result is written as Parquet and read again as the next one's documents.  A stage that begins deletes the
scratch tables of the stage before, whose result is written by then.

Null and blank texts have too few words for the quality rules and go there.  Rows without an id stay in the second and third
stage and are packed like any other; of rows that repeat an id and a text one stays; ties go to the least id.  Other columns, whatever
their names, are carried up to the packing.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import near, packing, quality, store, substring
from quern.session import load

SCRATCH, RESULTS = "pipeline", "pipeline-results"
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules or lie beyond their language's and source's fences go."""
    store.release(spark, SCRATCH)
    return quality.keep_good(docs, SCRATCH)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, directly or through others, the least id stays."""
    store.release(spark, SCRATCH)
    return near.first_of_each(docs, k=5, num=80, den=100, owner=SCRATCH)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that occur elsewhere are cut out; ``n_chars`` follows the text."""
    store.release(spark, SCRATCH)
    cut = substring.remove_repeats(docs, "text", 35)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of 2,048 tokens, with the piece's ids."""
    store.release(spark, SCRATCH)
    return packing.pieces(docs, public_tokenizers.path(TOKENIZER), owner=RESULTS)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("pack", pack)]

#: Sequence packing has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store.table(docs, name, RESULTS)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
