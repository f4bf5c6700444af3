"""From raw documents to token-ID files: toxicity, near duplicates, benchmark passages, source mix, output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import materialize, table
from thalweg.llm.decontaminate import decontaminate
from thalweg.llm.minhash import near_duplicates
from thalweg.llm.mixing import mix
from thalweg.llm.pfor import token_files
from thalweg.llm.tokens import tokenizer_path
from thalweg.llm.toxicity import score_toxicity, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=tuple(docs.columns)).where("_predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8) the document with the smallest id stays.

    Rows that repeat an id with other texts are documents of their own, told
    apart by a hash of id and text, which also decides between two of one id; of
    rows that repeat id and text the one whose columns come first as text stays.
    Rows without an id stay.
    """
    repeated = materialize(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "repeated-ids")
    if repeated.isEmpty():
        gone = near_duplicates(docs, width=5, share=80).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    kept = [F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*kept).alias("row"))
    name = F.when(F.col("_id").isNotNull(), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("doc_id")
    named = materialize(rows.join(repeated, F.col("id") == F.col("_id"), "left").select(name, "id", "text", "row"), "named-rows")
    groups = near_duplicates(named, width=5, share=80).where("doc_id is not null").select("doc_id", "component_id").distinct()
    first = named.select("doc_id", "id").distinct().join(groups, "doc_id").groupBy("component_id").agg(F.min(F.struct("id", "doc_id"))["doc_id"].alias("doc_id"))
    one = named.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.col("row").cast("string")).alias("row")).select("row")
    one = one.unionByName(named.where("doc_id is null").select("row"))
    return one.select(*[F.col(f"row._{k}").alias(c) for k, c in enumerate(docs.columns)])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover at least one word in twenty go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns)).where("not _contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked source, language and topic weights draw."""
    return mix(docs, keep=tuple(docs.columns)).where("sampled").select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files of what is left; one row for each document, read back from them."""
    return token_files(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Trained classifiers, MinHash and a vocabulary are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
