"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, html_main, jaccard_join, lang_id, license_scan, media, mixing, packing, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(license_scan.as_files(_table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(_fold(4) != 2))
    out = lang_id.identify(docs, model)
    return out.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_main.main_text(pages, html_main.train(pages))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(_fold(3) != 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def listed_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_url_filter that SQL can express."""
    return url_filter.listed_parts(_table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_language_id, op3_fingerprints, op4_jaccard_join, op5_html_main_text,
        op6_media_columns, op7_toxicity, op8_source_mixing, op9_packing, op10_url_filter, listed_url_parts,
    )
}
ORACLE = {"op1_license_scan": license_scan.ORACLE, "op4_jaccard_join": jaccard_join.ORACLE, "op8_source_mixing": mixing.ORACLE, "listed_url_parts": url_filter.ORACLE}
