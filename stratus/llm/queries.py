"""Registered queries of the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import decontaminate, html_text, lm_scoring, merkle, packing, phrases, quality, revisits, secrets, simhash, suffix_dedup, top_k, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The id of the end of a text in the vocabulary.
END_OF_TEXT = 50_256


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file: the environment's, or the installed one."""
    folder = os.environ.get("TOKENIZER_FOLDER")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, _table(spark, sf_dir, "benchmark")))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records derived from ``pages``: for every page a full
    response, for every third page a later changed response, and revisits
    before, between and after them with matching, outdated or no validators,
    under spellings of the URL that mean the same."""
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("d1")).withColumn(
        "d2", F.md5(F.concat("d1", F.lit("changed"))))
    tag = lambda c: F.concat(F.lit('"'), F.substring(c, 1, 16), F.lit('"'))
    date = lambda k: F.concat(F.lit("day "), (F.col("page_id") * 10 + k).cast("string"))
    none = F.lit(None).cast("string")

    def record(k, kind, when=None, url=None, etag=none, digest=none, modified=none):
        own = F.create_map(F.lit("Date"), date(k), F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag(digest)) \
            if kind == "response" else F.create_map(F.lit("Date"), date(k), F.lit("Cache-Control"), F.lit("max-age=60"),
                                                    F.lit("Content-Type"), F.lit("none"))
        made = F.struct(
            (F.col("page_id") * 10 + k).alias("record_id"), (url if url is not None else F.col("url")).alias("url"),
            (F.col("page_id") * 10 + k).alias("time"), F.lit(kind).alias("kind"), etag.alias("etag"),
            digest.alias("digest"), modified.alias("last_modified"), own.alias("headers"))
        return made if when is None else F.when(when, made)
    other = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("#again"))
    changed = F.col("page_id") % 3 == 0
    rows = F.array(
        record(0, "revisit", F.col("page_id") % 4 == 0),
        record(1, "response", None, None, tag("d1"), F.col("d1"), date(1)),
        record(2, "revisit", None, other, tag("d1")),
        record(4, "response", changed, other, tag("d2"), F.col("d2"), date(4)),
        record(5, "revisit", F.col("page_id") % 2 == 0, None, F.concat(F.lit("W/"), tag("d1"))),
        record(6, "revisit", F.col("page_id") % 5 == 0, other, none, F.col("d2")),
        record(7, "revisit", F.col("page_id") % 7 == 0, None, none, none, date(1)),
        record(8, "revisit", F.col("page_id") % 7 == 1))
    return base.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures(_table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "canonical", "status", "target_id", "digest",
                        F.array_join(lines, "\n").alias("headers"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), vocabulary_path(), END_OF_TEXT)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.without_line_feeds(F.col("doc_id"), F.col("text")))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_top_k_search, op3_simhash_near_dedup, op4_toxicity, op5_quality_classifier, op6_html_extraction,
    op7_benchmark_decontamination, op8_warc_revisits, op9_suffix_array_dedup, op10_secret_scan,
    op11_lm_scoring, op12_phrase_mining, op13_merkle_manifest,
)}
