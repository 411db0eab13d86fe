"""One query for each operator, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bytebpe, decontam, fim, langid, licenses, media, merkle, minhash, oracles, repeats, toxicity, urlfilter, warc, wrappers
from quire.llm.text import bounded_batches, shared_dir
from quire.session import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path of the rank file, and the pattern whose matches are encoded."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.evaluate(pages.withColumn("fetched_on", urlfilter.fetch_date()), urlfilter.entry_table(spark))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives stay in the shared folder: the result is read from them, revisits by their headers alone."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(table(spark, sf_dir, "pages"), folder)
    return warc.archived_pages(spark, folder)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images stay in the shared folder: the result is read from them."""
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    stored.write.parquet(folder)
    return media.read_payloads(spark.read.schema(stored.schema).parquet(folder))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the whole rows; what is presented for verification lacks its line ends where the id's CRC is even."""
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.leaf_digest(columns).alias("leaf"), merkle.leaf_digest([*columns[:-1], tampered]).alias("presented"))
    found = merkle.verify(merkle.manifest(leaves, carry=["presented"]), "in_presented")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


_ALL = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_minhash": op3_minhash,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_media_columns": op9_media_columns,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_html_extraction": op13_html_extraction,
}


def _bounded(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {name: _bounded(run) for name, run in _ALL.items()}

ORACLES = {
    "op1_suffix_array_dedup": oracles.REPEATS,
    "op3_minhash": oracles.NEAR_DUPLICATES,
    "op4_decontamination": oracles.CONTAMINATION,
    "op2_license_scan": licenses.oracle(),
    "op6_url_filter": urlfilter.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_html_extraction": wrappers.ORACLE,
    "op8_warc": """
WITH x AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM x WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM x LEFT JOIN f USING (h)""",
}
