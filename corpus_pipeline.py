"""A corpus pipeline of five stages, each over all that the one before it kept.

toxicity: documents scored 0.7 or more go. line_dedup: passages of 50 words or more that
repeat an earlier one are cut; the documents stay. near_dedup: of documents whose
fingerprints are linked, the one with the least doc_id stays. decontamination: documents of
which a twentieth or more lies in benchmark windows go. packing: the rest, as pieces of
sequences of 1024 tokens.

Near duplicates are told by the SimHash rule of the query: 3-word shingles, fingerprints that
differ in 2 bits at most. Columns besides those of the table documents pass through unchanged,
whatever their names, up to the last stage, which returns its own; ``n_chars`` is that of the
text as cut. Null texts are kept as empty ones, rows that repeat both doc_id and text become
one in near_dedup, and an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import decontam, line_dedup, packing, simhash, toxicity
from vigil.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into="__toxicity").where("__toxicity < 0.7").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs, added=("n_chars", "__cut_runs", "__cut_words")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), prefix="__found_")
    return found.where(~decontam.contaminated("__found_")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeats),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained network and tokenizers are no SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every other stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
