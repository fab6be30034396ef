"""A corpus clean-up in stages, each of which calls one training-data operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last keep the columns
of `documents`; the last returns one row per document that is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import bpe, langid, simhash
from aerolith.llm.common import dropped, fresh, read, stored
from aerolith.llm.decontaminate import with_contamination
from aerolith.llm.linededup import dedup_lines


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter in it go, by the operator's own finding; the others without a language
    get the one that is predicted.

    Nothing else is rejected: not an unlabelled or unlikely language, and not a table without labels, for which there is
    no model."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = fresh(docs, "found")
    marked = docs.withColumn(found, langid.language_column(docs, langid.fit(docs.where(~held_out))))
    known = F.when(F.col(found)["lang_pred"] != langid.UNDETERMINED, F.col(found)["lang_pred"])
    return marked.where(F.col(found)["readable"]).withColumn("lang", F.coalesce("lang", known)).drop(found)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents hold go from all of them."""
    marked = dedup_lines(docs)
    lines = marked.columns[-1]
    text = F.col(lines)["kept"]
    return marked.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    marked = with_contamination(docs, read(spark, sf_dir, "benchmark"), with_spans=False)
    scan = marked.columns[-1]
    hit, words = F.col(scan)["n_hit"], F.col(scan)["n_words"]
    return marked.where(~((hit > 0) & (20 * hit >= words))).drop(scan)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the text decoded from them."""
    how = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    found = bpe.digest_column(F.col("text"), *how, bpe.shared_chunks(docs, *how))
    return docs.select("doc_id", "lang", "source", found.alias("t")).select("doc_id", "lang", "source", "t.*")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokens)]

#: SQL has neither the language model nor XXH64; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; what a stage keeps is written to the cluster's shared folder, and removed when the
    next stage is written."""
    docs, folders = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folders, compression=None)
        dropped(spark, folders[-2:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
