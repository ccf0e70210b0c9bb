"""Queries over the driver's tables: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import bpe, classifier, curves, licenses, middle, mixing, neardup, pages, phrases, rules, sharding, vectors, warc
from leafmill.llm.common import table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion of every page; the record itself as its digest."""
    found = warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return found.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "target_uri",
        "warc_date",
        "content_type",
        "content_length",
        "block_digest",
        "payload_digest",
        F.sha2(F.col("record"), 256).alias("record_sha256"),
    )


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: five-word shingles, similarity 0.75 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; sources weigh 5, 2, 1, at most 3 times each."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and what they decode to, as digests."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), bpe.default_vocabulary(spark))


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op6_subspace_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95 or more."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels of other folds than 0."""
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of boosted trees for all documents."""
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that whole texts are, and known notices on their lines."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of near equal bytes for all documents."""
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_sketch_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two to five words that occur 100 times or more."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every twentieth vector."""
    return curves.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op13_automaton_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text rearranged at two of its lines, and restored, as digests."""
    return middle.digests(middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives,
        op2_minhash_neardup,
        op3_weighted_mix,
        op4_bpe_lexicon,
        op5_html_wrappers,
        op6_subspace_vectors,
        op7_kernel_quality,
        op8_quality_rules,
        op9_license_digests,
        op10_kd_shards,
        op11_sketch_collocations,
        op12_hilbert_neighbours,
        op13_automaton_middle,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLES = {
    "op3_weighted_mix": mixing.MIX_SQL.replace("{docs}", "documents"),
    "op11_sketch_collocations": phrases.PHRASES_SQL.replace("{least}", "100"),
    "op13_automaton_middle": middle.MIDDLE_SQL,
    "op9_license_digests": licenses.scan_sql("documents"),
}
