"""Corpus pipeline: documents to token files in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in
the shared checkpoint folder and read again as the next stage's ``docs``, so a lost
executor never replays an earlier stage. All stages but the last return the columns of
``documents``:

1. quality rules: documents that fail the base counts or the compression bands go;
2. n-gram Jaccard join: of each group of near duplicates the smallest id stays;
3. benchmark decontamination: contaminated documents go;
4. mixing: every source's share of the words, a row for each pass over a document
   (a document taken twice has two rows, one partly taken has the taken words);
5. token files: ids in the file format, read back as doc_id, start, n_tokens, ids_crc32.

The mixing has no oracle in SQL beside it (its predecessors, compression and the
tokenizer, cannot be expressed), so ``ORACLE_SQL`` is None; tests hold the whole
pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelens.llm import op02_tokens, op03_jaccard, op04_quality, op07_mixing, op10_decontam
from wavelens.llm.queries import tokenizer_path
from wavelens.llm.store import fresh_path, stage
from wavelens.sources.tables import read_table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op07_mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "pipeline-tokens")
    op02_tokens.write(docs, path, tokenizer_path(), end_id=2)
    return op02_tokens.read(spark, path, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents`` of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else stage(out, f"pipeline-{i + 1}")
    return docs
