"""From raw documents to token ids, in five stages over whole tables.

Quality rules, quality classifier, near-duplicate removal, mixing of sources
and BPE encoding. Each stage takes what the one before kept; its result is
written as Parquet in the shared checkpoint folder and read again, so a lost
executor costs one stage's tasks at most.

All stages take rows as they are: other columns of any name come through the
first four unchanged, texts are read whole, and an empty table gives an empty
table. What each does with nulls, empty texts and repeated rows is said there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, classifier, mixing, neardup, rules
from leafmill.llm.common import cut, release, remove_folder, shared_folder, table
from leafmill.llm.stats import drawn_ids, with_stats


def _where(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], passes: str) -> DataFrame:
    """Rows of ``docs`` that pass; columns whose names the judge uses are set apart meanwhile."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    judged = judge(docs.withColumnsRenamed(names)).where(passes)
    return judged.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _labelled_stats(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id and stat_features of the documents of ``docs`` with the labels that a model is fitted on.

    Their ids, about ``fit_rows`` at most, are sent to all tasks; no texts are shuffled.
    """
    named = docs.select("doc_id", "text").join(F.broadcast(drawn_ids(labels, "quality", fit_rows)), "doc_id", "left_semi")
    return cut(with_stats(named).select("doc_id", "stat_features"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees.

    Null, empty and blank texts have too few words and go. Repeated rows share
    one verdict; rows without doc_id are judged by their text. Trees are fitted
    on the labelled documents; without labels the base rules decide alone.
    """
    labels = table(spark, sf_dir, "labels")
    forest = rules.fit(_labelled_stats(docs, labels, rules.FIT_ROWS), labels)
    return _where(docs, lambda d: rules.judge_texts(d, forest), "kept")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good.

    It is fitted on the labelled rows of the whole documents table, bad ones
    that an earlier stage has taken away included. Null and empty texts have a
    score as well; repeated rows share it; rows without doc_id are scored too.
    """
    labels = table(spark, sf_dir, "labels")
    model = classifier.fit(_labelled_stats(table(spark, sf_dir, "documents"), labels, classifier.FIT_ROWS), labels)
    return _where(docs, lambda d: classifier.score_texts(d, model), "predicted = 1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Null, empty and blank texts are near to nothing and stay, as do rows without
    id. Of rows that share an id one stays, that of the least hash of all columns.
    """
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("kept_id"), mark.alias("row_mark"))
    picked = rows.groupBy("kept_id").agg(F.min("row_mark").alias("row_mark")).join(kept, "kept_id", "left_semi")
    whole = rows.join(picked, ["kept_id", "row_mark"], "left_semi").dropDuplicates(["kept_id", "row_mark"])
    return whole.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those not taken go.

    Null and empty texts hold no words and cost nothing: they go with the whole
    epochs. Null is a source of its own, the last. Rows without id are drawn by
    their text and source; rows of one id are taken equally often.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", "source"))
    taken = mixing.mix_sources(docs.select(key.alias("doc_id"), "source", "text")).groupBy("doc_id").agg(F.max("epochs").alias("mix_epochs"))
    taken = cut(taken.where("mix_epochs > 0").withColumnRenamed("doc_id", "mix_key"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    return docs.alias("d").join(taken, key == F.col("mix_key")).select(*columns, F.explode(F.sequence(F.lit(1), F.col("mix_epochs").cast("int"))).alias("mix_epoch")).drop("mix_epoch")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document taken.

    Null and empty texts have no ids. Repeated rows, as the mix makes them, and
    rows without doc_id are encoded each; other columns are left out.
    """
    return bpe.token_digests(docs, bpe.default_vocabulary(spark), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: Boosted trees, kernel ridge and tokenizer merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's folder goes once the next is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = f"{folder}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            release(spark)
            if last:
                remove_folder(spark, last)
            last = here
    return docs
