"""The corpus pipeline: from raw documents to token ids, in five stages.

1. language_id: documents whose language isn't recognised go;
2. line_dedup: lines that repeat earlier lines go (equal, one word in four or one
   character in eight away, or differing in spaces), and documents left without words;
3. near_duplicates: of each group of near copies (5-word shingles, Jaccard
   0.8 or more, linked directly or through others) the smallest doc_id stays;
4. decontaminate: documents that hold a benchmark item go;
5. tokenize: SentencePiece ids of each whole text, and the text decoded from them.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
has kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dealforge.llm import decontaminate as leaks
from dealforge.llm import jaccard_join, line_dedup, sentencepiece_codec
from dealforge.llm import language_id as languages
from dealforge.llm.common import fresh_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return languages.keep_identified(docs, languages.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_new_lines(docs, **line_dedup.SHORT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_and_decode(docs, model, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The language model, the edit-bounded search and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
