"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Null or empty texts have no letters and go in the first stage. Rows that are equal in id and text are one document:
they are judged alike in every stage, and stay or go together. Rows that share an id and differ in text are judged
each by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bytebpe, decontam, langid, minhash, repeats
from quire.llm.queries import vocabulary
from quire.llm.text import bounded_batches, remove_folder, shared_dir
from quire.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The least score of a document in ``LANGUAGES`` languages or fewer.
MIN_SCORE, LANGUAGES = 0.3, 4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing ``lang`` becomes the predicted one, a given one stays.

    Those without a text or a letter go, and those to which the network gives no language ``MIN_SCORE`` on average (of
    four languages the best has 0.25 at least; on the tables of sf0.1 and the check no document is below). With more
    languages the floor is lower in proportion, as an even share is. Where no row has a
    language to learn from, nothing can be told, and every document with a letter stays as it is.
    """
    bounded_batches(spark)
    known = langid.learnable(docs, "doc_id", "text", "lang").select("l").distinct().count()
    if not known:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    floor = min(MIN_SCORE, MIN_SCORE * LANGUAGES / known)
    found = langid.identify(docs, carry=COLUMNS).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= floor))
    return found.select(*[(F.coalesce("in_lang", "lang_pred") if c == "lang" else F.col(f"in_{c}")).alias(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id. Rows are told by id and a hash of their text, so that a dropped text does not come back with another one of its id."""
    bounded_batches(spark)
    text_hash = F.xxhash64("text")
    judged = minhash.near_duplicates(docs.select("doc_id", "text", text_hash.alias("hash")), carry=["hash"])
    kept = judged.filter("kept").select(F.col("doc_id").alias("id"), F.col("in_hash").alias("hash")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.id) & (text_hash == kept["hash"]), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has too; broken characters at the cuts go, as do documents of which nothing is left."""
    bounded_batches(spark)
    found = repeats.remove_repeats(docs, carry=["doc_id", "lang", "source"], as_text=True).filter("n_bytes = 0 or kept != ''")
    return found.select(F.col("in_doc_id").alias("doc_id"), F.col("kept").alias("text"), F.col("in_lang").alias("lang"), F.col("in_source").alias("source"), F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    bounded_batches(spark)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS).filter(~F.col("contaminated"))
    return found.select(*[F.col(f"in_{c}").alias(c) for c in COLUMNS])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the decoded bytes, and the language that the first stage found."""
    bounded_batches(spark)
    return bytebpe.round_trip(docs, *vocabulary(), with_ids=True, carry=["lang"]).withColumnRenamed("in_lang", "lang")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
#: The network and BPE have no SQL; tests/llm/test_pipeline.py compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's table is removed once the next one is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
